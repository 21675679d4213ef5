"""Retrieved tables joined to questions: gold places, hits with tables, hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import checkpoint
from . import match
from .retrieval import TASK_ROWS, partitions

#: Fixed value: the table id of a question's negative when none is left.
FAKE = "FAKE"


def with_tables(hits: DataFrame, tables: DataFrame) -> DataFrame:
    """Hits with their table (the first of equal ids, by all columns); a hit of an unknown table is an error."""
    names = [c for c in tables.columns if c != "table_id"]
    first = tables.groupBy("table_id").agg(F.min(F.struct(*names)).alias("_t")).withColumn("_known", F.lit(True))
    met = hits.join(first, "table_id", "left")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no table "), F.coalesce("table_id", F.lit("null"))))).otherwise(F.col("_t"))
    return met.withColumn("_t", known).select(*hits.columns, "_t.*")


def hard_negatives(interactions: DataFrame, hits: DataFrame, n: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(question_id, place, table_id, score)``: the first ``n`` hits of each question that cannot answer it.

    ``interactions``: ``question_id, gold_id, answers array<string>``; ``hits``: ``question_id, table_id, rank, score,
    table_text`` or ``cells``, an array of the texts of header and cells. Repeated hits, the gold table and tables that
    contain every answer (each in one of the cells, where they come as such) are left out; a question without any left
    gets one ``FAKE`` table with score 0. Scores are negated; hits of unknown questions are dropped.
    """
    told = "cells" if "cells" in hits.columns else "table_text"
    # all steps are by question: one shuffle of each side, in as many partitions as keep a task's hits bounded
    places = partitions(hits, hits.count(), task_rows)
    hits, interactions = hits.repartition(places, "question_id"), interactions.repartition(places, "question_id")
    best = hits.groupBy("question_id", "table_id").agg(F.min(F.struct("rank", "score", told)).alias("h")).select("question_id", "table_id", "h.*")
    met = best.join(interactions.select("question_id", "gold_id", "answers"), "question_id")
    if told == "cells":
        inside = F.forall("answers", lambda a: F.exists(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(F.contains(c, a), F.lit(False))))
    else:
        inside = match.contains_all(F.col("table_text"), F.col("answers"))
    holds = (F.size("answers") > 0) & inside
    wrong = met.where((F.col("table_id") != F.coalesce("gold_id", F.lit(""))) & ~F.coalesce(holds, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "table_id")) - 1
    some = wrong.withColumn("place", place).where(F.col("place") < n).select("question_id", "place", "table_id", (-F.col("score")).alias("score"))
    none = interactions.select("question_id").distinct().join(some.select("question_id").distinct(), "question_id", "left_anti")
    return some.unionByName(none.select("question_id", F.lit(0).alias("place"), F.lit(FAKE).alias("table_id"), F.lit(0.0).alias("score")))


def gold_places(queries: DataFrame, tables: DataFrame, width: int) -> DataFrame:
    """``(query_id, places array<int>)``: where the gold tables stand in the id-sorted candidates, padded with -1.

    Candidates are numbered by a sort and per-partition counts, not in one task. A missing gold table is an error.
    """
    # an id that increases in a partition: its upper bits are the partition's number, the lower 33 the row's place in it
    ordered = checkpoint(tables.select("table_id").distinct().sort("table_id").withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").select("table_id", (F.col("_start") + row).alias("place"))
    gold = queries.select("query_id", F.explode("table_ids").alias("table_id")).join(numbered, "table_id", "left")
    gold = gold.withColumn("place", F.when(F.col("place").isNull(), F.raise_error(F.concat(F.lit("unknown gold table "), "table_id"))).otherwise(F.col("place")))
    lists = gold.groupBy("query_id").agg(F.sort_array(F.collect_list(F.col("place").cast("int"))).alias("p"))
    return lists.select("query_id", F.slice(F.concat("p", F.array_repeat(F.lit(-1), width)), 1, width).alias("places"))


def retriever_info(questions: DataFrame, hits: DataFrame, with_gold: bool) -> DataFrame:
    """``(question_id, table_id, rank, score, is_gold)``: hits by rank from 1, and gold tables that no hit names (null rank).

    ``questions``: ``question_id, gold_id``; ``hits``: ``question_id, table_id, score`` where smaller is better.
    """
    order = Window.partitionBy("question_id").orderBy("score", "table_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).select("question_id", "table_id", "rank", "score")
    gold = questions.select("question_id", F.col("gold_id").alias("table_id"), F.lit(True).alias("is_gold"))
    met = ranked.join(gold, ["question_id", "table_id"], "full" if with_gold else "left")
    return met.join(questions.select("question_id"), "question_id", "left_semi").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
