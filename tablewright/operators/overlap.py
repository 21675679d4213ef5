"""Columns and cells of a table that share word stems with a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import stem_set


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 of two empty ones."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def _stemmed(cells: DataFrame) -> DataFrame:
    return cells.select("table_id", "row_index", "column_index", F.coalesce(stem_set("text"), F.array().cast("array<string>")).alias("stems"))


def _gathered(stemmed: DataFrame, by: str) -> DataFrame:
    """The set of stems in each row or column: distinct before they are gathered."""
    parts = stemmed.select("table_id", by, F.explode_outer("stems").alias("s")).distinct()
    return parts.groupBy("table_id", by).agg(F.collect_set("s").alias("stems"))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "table_id", F.coalesce(stem_set("question"), F.array().cast("array<string>")).alias("asked"))


def score_columns(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """``(question_id, table_id, column_index, score, rank)``: Jaccard of each column's stems and the question's.

    ``questions(question_id, table_id, question)``, ``cells(table_id, row_index, column_index, text)``. Ties in
    ``rank`` go to the smaller column. Null texts have no stems.
    """
    scored = _asked(questions).join(_gathered(_stemmed(cells), "column_index"), "table_id").select("question_id", "table_id", "column_index", jaccard(F.col("stems"), F.col("asked")).alias("score"))
    return _ranked(scored, "column_index")


def score_cells(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """``(question_id, table_id, row_index, column_index, score, rank)``: a cell's overlap plus its row's and column's."""
    stemmed, asked = _stemmed(cells), _asked(questions)
    rows = _gathered(stemmed, "row_index").withColumnRenamed("stems", "_r")
    columns = _gathered(stemmed, "column_index").withColumnRenamed("stems", "_c")
    wide = stemmed.join(rows, ["table_id", "row_index"]).join(columns, ["table_id", "column_index"]).join(asked, "table_id")
    score = jaccard(F.col("_c"), F.col("asked")) + jaccard(F.col("_r"), F.col("asked")) + jaccard(F.col("stems"), F.col("asked"))
    return _ranked(wide.select("question_id", "table_id", "row_index", "column_index", score.alias("score")), "column_index", "row_index")


def _ranked(scored: DataFrame, *ties: str) -> DataFrame:
    from pyspark.sql.window import Window

    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "table_id").orderBy(F.desc("score"), *ties)))
