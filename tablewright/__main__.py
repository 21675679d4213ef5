"""Tasks from the command line: ``python -m tablewright TASK ...`` on the session that spark-submit or the defaults give.

Tasks compose operators of the package; results are Parquet folders, or files in the forms that the readers read.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import evaluate, grammar, prepare, retrieval
from .schema import to_cells
from .sources import readers, records, sinks


def interactions(spark: SparkSession, source: str, target: str, kind: str = "interaction") -> None:
    """Interaction or table messages as Parquet."""
    records.inputs(spark, source, kind).write.mode("overwrite").parquet(target)


def pretrain(spark: SparkSession, source: str, target: str, copies: int = 1, rows: int = 0, columns: int = 0) -> None:
    """Interactions with questions and a large enough table, in copies, written by split."""
    kept = prepare.pretraining(spark.read.parquet(source), copies, rows, columns)
    kept.write.mode("overwrite").partitionBy("split").parquet(target)


def statements(spark: SparkSession, source: str, target: str, seed: int = 0) -> None:
    """True and false statements about the tables of interactions, one table an id."""
    cells = to_cells(spark.read.parquet(source).select("table.*").dropDuplicates(["table_id"]))
    grammar.statements(cells.select("table_id", "row_index", "column_name", "text"), seed=seed).write.mode("overwrite").parquet(target)


def retrieve(spark: SparkSession, source: str, target: str, k: int = 10) -> None:
    """The ``k`` best tables of each question by BM25 over title, header and cells, as hit lists."""
    rows = spark.read.parquet(source)
    cells = F.flatten(F.transform("table.rows", lambda r: F.transform(r["cells"], lambda c: c["text"])))
    header = F.transform("table.columns", lambda c: c["text"])
    said = F.concat_ws(" ", F.col("table.document_title"), F.concat_ws(" ", header), F.concat_ws(" ", cells))
    tables = rows.where("table.table_id IS NOT NULL").select(F.col("table.table_id").alias("table_id"), said.alias("said")).dropDuplicates(["table_id"])
    questions = rows.select(F.explode("questions").alias("q")).select(F.col("q.id").alias("query_id"), F.col("q.text").alias("said"))
    asked = retrieval.asked_terms(questions, "query_id", text.tokenize("said"))
    index = retrieval.bm25_index(tables, "table_id", text.tokenize("said"), asked=asked)
    scores = retrieval.lookup(asked, "query_id", index, "table_id", "weight")
    sinks.hits(retrieval.best(scores, "query_id", "table_id", k), target)


def metrics(spark: SparkSession, source: str, predictions: str) -> DataFrame:
    """How often aggregation, cells and both are right; a question without a prediction counts as NONE and no cells."""
    questions = spark.read.parquet(source).select(F.explode("questions").alias("q"))
    gold = F.transform(F.coalesce("q.answer.answer_coordinates", F.array().cast("array<struct<row_index:int,column_index:int>>")), lambda c: F.struct(c["row_index"].alias("row"), c["column_index"].alias("col")))
    examples = questions.select(F.col("q.id").alias("question_id"), F.coalesce("q.answer.aggregation_function", F.lit("NONE")).alias("aggregation"), gold.cast("array<struct<row:int,col:int>>").alias("coordinates"))
    found = readers.predictions_tsv(spark, predictions)
    said = F.upper("aggregation") if "aggregation" in found.columns else F.lit("NONE")
    preds = found.select("question_id", said.alias("aggregation"), F.col("answer_coordinates").cast("array<struct<row:int,col:int>>").alias("coordinates"))
    return evaluate.structure(evaluate.join_predictions(examples, preds))


def hit_rate(spark: SparkSession, hits: str, source: str, ks: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """The share of questions whose own table is among the first k hits; questions without hits count as missed."""
    found = readers.hits_jsonl(spark, hits)
    gold = spark.read.parquet(source).select(F.explode("questions.id").alias("query_id"), F.col("table.table_id").alias("gold_id"))
    met = gold.join(found, "query_id", "left").withColumn("rank", F.col("rank") + 1)
    return retrieval.hit_rate(met, "query_id", F.col("table_id") == F.col("gold_id"), list(ks))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tablewright", description=__doc__)
    tasks = parser.add_subparsers(dest="task", required=True)
    for f, paths, options in (
        (interactions, ("source", "target"), {"kind": "interaction"}), (pretrain, ("source", "target"), {"copies": 1, "rows": 0, "columns": 0}),
        (statements, ("source", "target"), {"seed": 0}), (retrieve, ("source", "target"), {"k": 10}),
        (metrics, ("source", "predictions"), {}), (hit_rate, ("hits", "source"), {}),
    ):
        task = tasks.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for path in paths:
            task.add_argument(path)
        for name, default in options.items():
            task.add_argument(f"--{name}", type=type(default), default=default, choices=("interaction", "table") if name == "kind" else None)
        task.set_defaults(run=f)
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[dict] | None:
    """Runs a task; the rows of a report are printed as JSON lines and returned."""
    options = vars(_parser().parse_args(arguments))
    run, _ = options.pop("run"), options.pop("task")
    out = run(spark or SparkSession.builder.appName("tablewright").getOrCreate(), **options)
    if out is None:
        return None
    rows = [r.asDict(recursive=True) for r in out.collect()]  # a report: one row, or one for each k
    for row in rows:
        print(json.dumps(row))
    return rows


if __name__ == "__main__":
    main(sys.argv[1:])
