"""Writers. All write distributed files; a single file is written only by ``one_file``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def partitioned_split(df: DataFrame, table_id: str, path: str, n: int = 100) -> None:
    """Train and test folders by the hash of the table id."""
    df.withColumn("split", text.split_of(table_id, n)).write.mode("overwrite").partitionBy("split").parquet(path)


def route(df: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """``split``: ids of the train prefix by the hash of the title (0.9 train, else dev), dev prefix to test."""
    prefix = F.regexp_extract(id_col, r"^([a-z]+)", 1)
    split = F.when(prefix == "train", F.when(text.unit_float(title_col) < 0.9, "train").otherwise("dev")).when(prefix == "dev", "test")
    return df.withColumn("split", F.when(split.isNull(), F.raise_error(F.lit("unknown id prefix"))).otherwise(split))


def coordinates_text(c: Column) -> Column:
    """Cells as ``['(1, 2)', ...]``, column by column."""
    cells = F.array_sort(F.transform(c, lambda x: F.struct(x["col"].alias("col"), x["row"].alias("row"))))
    return F.concat(F.lit("["), F.array_join(F.transform(cells, lambda x: F.format_string("'(%d, %d)'", x["row"], x["col"])), ", "), F.lit("]"))


def predictions(df: DataFrame, path: str) -> None:
    """Prediction TSV with a header even for no rows; padding rows are left out."""
    df.where(F.col("question_id") != "EMPTY-0_0").withColumn("answer_coordinates", coordinates_text(F.col("answer_coordinates"))).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def hits(df: DataFrame, path: str) -> None:
    """Neighbours, one query a line; scores negated, so smaller is better."""
    one = F.sort_array(F.collect_list(F.struct("rank", "table_id", (-F.col("score")).alias("score"))))
    lists = df.groupBy("query_id").agg(F.transform(one, lambda x: F.struct(x["table_id"].alias("table_id"), x["score"].alias("score"))).alias("table_scores"))
    lists.write.mode("overwrite").json(path)


def answer_lines(examples: DataFrame, preds: DataFrame, path: str) -> None:
    """One line for each id: the first prediction's sorted answers, tab-joined; bare ids without one."""
    first = preds.groupBy("id").agg(F.min_by("answers", "place").alias("answers"))
    lines = examples.select("id").distinct().join(first, "id", "left")
    lines.select(F.concat_ws("\t", "id", F.array_sort("answers")).alias("value")).write.mode("overwrite").text(path)


def best_answers(preds: DataFrame, questions: DataFrame) -> DataFrame:
    """The best-scored answer of each question, an empty text if it has none."""
    best = preds.groupBy("question_id").agg(F.max(F.struct("score", F.col("answer").alias("pred"))).getField("pred").alias("pred"))  # ties to the greater text
    return questions.join(best, "question_id", "left").select("question_id", F.coalesce("pred", F.lit("")).alias("pred"))


def report(df: DataFrame, file_col: str, error_col: str) -> DataFrame:
    """Total, valid and failed rows for each file."""
    return df.groupBy(file_col).agg(F.count("*").alias("total"), F.count_if(F.col(error_col).isNull()).alias("valid"), F.count_if(F.col(error_col).isNotNull()).alias("failed"))


def one_file(df: DataFrame, path: str) -> None:
    """A single JSON part, for results that are known to be small."""
    df.coalesce(1).write.mode("overwrite").json(path)


def text_message(c: Column, kind) -> Column:
    """A struct in text format, fields in order, nulls left out."""
    from pyspark.sql import types as T

    def one(name, x, k):
        if isinstance(k, T.ArrayType):
            return F.array_join(F.transform(x, lambda v: one(name, v, k.elementType)), " ")
        if isinstance(k, T.StructType):
            return F.when(x.isNotNull(), F.concat(F.lit(f"{name} {{ "), text_message(x, k), F.lit(" }")))
        if isinstance(k, T.StringType):
            for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
                x = F.replace(x, F.lit(plain), F.lit(escaped))
            return F.concat(F.lit(f'{name}: "'), x, F.lit('"'))
        return F.concat(F.lit(f"{name}: "), x.cast("string"))

    return F.concat_ws(" ", *[F.nullif(one(f.name, c[f.name], f.dataType), F.lit("")) for f in kind.fields])


def messages(df: DataFrame, path: str, compression: str = "none") -> None:
    """Rows as text-format messages, one a line."""
    lines = df.select(text_message(F.struct(*df.columns), df.schema).alias("value"))
    lines.write.mode("overwrite").option("compression", compression).text(path)


def tables_csv(cells: DataFrame, path: str) -> None:
    """Every table as a folder of its own of quoted CSV lines, the header's first: one write, partitioned by table."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_index", F.col(name).alias("x")))), lambda c: quoted(c["x"])), ",")
    rows = cells.groupBy("table_id", "row_index").agg(line("text").alias("value"))
    head = cells.where("row_index = 0").groupBy("table_id").agg(line("column_name").alias("value")).withColumn("row_index", F.lit(-1))
    dealt = rows.unionByName(head).repartition("table_id").sortWithinPartitions("table_id", "row_index")
    dealt.select("table_id", "value").write.mode("overwrite").partitionBy("table_id").text(path)


def statements_xml(statements: DataFrame, labels: DataFrame, path: str) -> None:
    """Statements with their majority label (``unknown`` without one) as XML rows."""
    met = statements.join(labels, "statement_id", "left").select(F.col("statement_id").alias("_id"), F.col("text").alias("_text"), F.coalesce(F.col("label"), F.lit("unknown")).alias("_type"))
    met.write.mode("overwrite").format("xml").option("rowTag", "statement").option("rootTag", "statements").save(path)
