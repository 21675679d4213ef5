"""Ranks, runs, positions and reductions over the cells and tokens of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Dense rank from 1 and inverse dense rank; 0 for rows without a value."""
    w = Window.partitionBy(*group)
    up, down = F.dense_rank().over(w.orderBy(F.col(value).asc_nulls_last())), F.dense_rank().over(w.orderBy(F.col(value).desc_nulls_last()))
    some = F.col(value).isNotNull()
    return df.withColumn("rank", F.when(some, up).otherwise(0)).withColumn("inverse_rank", F.when(some, down).otherwise(0))


def previous(df: DataFrame, group: list[str], order: list[str], value: str, default=None) -> DataFrame:
    return df.withColumn("previous", F.lag(value, 1, default).over(Window.partitionBy(*group).orderBy(*order)))


def running_text(df: DataFrame, group: list[str], order: list[str], value: str, separator: str = " ") -> DataFrame:
    """All texts of the group up to and with the row's own."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.array_join(F.collect_list(value).over(w), separator))


def islands(df: DataFrame, group: list[str], order: list[str], hit: Column, score: Column) -> DataFrame:
    """Maximal runs of consecutive hits: first and last position, length and geometric mean of their scores."""
    w = Window.partitionBy(*group).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(w)).withColumn("_s", score).where(hit)
    keyed = numbered.withColumn("_k", F.col("_i") - F.row_number().over(Window.partitionBy(*group).orderBy("_i")))
    return keyed.groupBy(*group, "_k").agg(F.min("_i").alias("begin"), F.max("_i").alias("end"), F.count("*").alias("n"), F.exp(F.avg(F.ln("_s"))).alias("score")).drop("_k")


def run_edges(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``is_start`` and ``is_end`` of runs of label 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    x = F.col(label)
    return df.withColumn("is_start", (x - F.lag(x, 1, 0).over(w) > 0).cast("int")).withColumn("is_end", (x - F.lead(x, 1, 0).over(w) > 0).cast("int"))


def relative_position(df: DataFrame, group: list[str], position: str, most: int) -> DataFrame:
    return df.withColumn("relative", F.least(F.lit(most - 1), F.col(position) - F.min(position).over(Window.partitionBy(*group))))


def buckets_by_rank(df: DataFrame, group: list[str], order: list, size: int, header: int = 0) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("bucket", F.greatest(F.floor((at - header) / size) + 1, F.lit(0)).cast("int"))


def top_mask(df: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    return df.withColumn("kept", (F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie)) <= k).cast("int"))


def reduce_segments(df: DataFrame, batch: str, segment: str, value: str, segments: int) -> DataFrame:
    """Mean, sum, max and min for each of ``segments`` segments of every batch; empty ones give mean and sum 0."""
    grid = df.select(batch).distinct().withColumn(segment, F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    found = df.groupBy(batch, segment).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.max(value).alias("greatest"), F.min(value).alias("least"))
    joined = grid.join(found, [batch, segment], "left")
    return joined.withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("total", F.coalesce("total", F.lit(0.0)))


def nested_mean(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean of the cells' means."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("score"))


def type_vote(cells: DataFrame, group: list[str], has_number: Column, has_date: Column, least: float = 0.7) -> DataFrame:
    """The type that at least ``least`` of a column's rows have: number or date, ties to date; else null."""
    votes = cells.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(has_number).alias("numbers"), F.count_if(has_date).alias("dates"))
    most = F.greatest("numbers", "dates")
    return votes.withColumn("type", F.when(most / F.col("n") < least, F.lit(None).cast("string")).when(F.col("dates") == most, F.lit("date")).otherwise(F.lit("number")))


def relation_mask(values: DataFrame, group: list[str], relation: Column) -> DataFrame:
    """All relations of a cell to a question's values as one bit mask."""
    return values.groupBy(*group).agg(F.coalesce(F.bit_or(relation), F.lit(0)).alias("mask"))


def soft_aggregates(tokens: DataFrame, group: list[str], p: str, value: str, scale: str) -> DataFrame:
    """Expected count, sum and average of cells chosen with probability ``p``; a cell of n tokens counts 1/n each."""
    w = F.col(p) / F.col(scale)
    known = F.when(~F.isnan(value), F.col(value)).otherwise(0.0)
    return tokens.groupBy(*group).agg(F.sum(w).alias("expected_count"), F.sum(w * known).alias("expected_sum"), (F.sum(w * known) / (F.sum(w) + 1e-10)).alias("expected_average"))


def distribution(df: DataFrame, group: list[str], order: list[str], tiles: int = 4) -> DataFrame:
    """``tile, percent_rank, cume_dist`` of each row in its group's order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({"tile": F.ntile(tiles).over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w)})


def within_range(df: DataFrame, group: list[str], at: str, low: int, high: int, value: str) -> DataFrame:
    """``around``: the sum of the values of rows whose ``at`` lies from ``low`` below to ``high`` above the row's own."""
    w = Window.partitionBy(*group).orderBy(at).rangeBetween(-low, high)
    return df.withColumn("around", F.sum(value).over(w))


def excluding(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], preceding: int | None, following: int | None, exclude: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts over a frame of rows that leaves some of them out: SQL's EXCLUDE, which Spark's frames lack.

    The frame reaches ``preceding`` rows back and ``following`` ahead (None: to the end of the group) in the order of the
    columns ``order``, rows that are equal in these (peers) by ``then``. ``exclude`` is ``current row``, ``group`` (the row
    and its peers) or ``ties`` (the peers without the row). Each of ``values`` is a number to sum: ``<name>`` is the sum,
    null over no numbers, and ``<name>_n`` their count. Peers follow each other, so what the frame shares with them is
    the same frame over the peers alone; the result is the difference of the two.
    """
    if exclude not in ("current row", "group", "ties"):
        raise ValueError(f"unknown exclusion: {exclude}")
    low, high = Window.unboundedPreceding if preceding is None else -preceding, Window.unboundedFollowing if following is None else following
    frame = Window.partitionBy(*group).orderBy(*order, *then).rowsBetween(low, high)
    shared = Window.partitionBy(*group, *order).orderBy(*(then or order)).rowsBetween(low, high)
    own = (preceding is None or preceding >= 0) and (following is None or following >= 0)
    out = df
    for name, value in values.items():
        number = value.cast("double")
        total = lambda w: F.coalesce(F.sum(number).over(w), F.lit(0.0))  # noqa: B023, E731
        self_sum, self_n = (F.coalesce(number, F.lit(0.0)), number.isNotNull().cast("long")) if own else (F.lit(0.0), F.lit(0).cast("long"))
        gone = {
            "current row": (self_sum, self_n), "group": (total(shared), F.count(number).over(shared)),
            "ties": (total(shared) - self_sum, F.count(number).over(shared) - self_n),
        }[exclude]
        count = F.count(number).over(frame) - gone[1]
        out = out.withColumns({f"{name}_n": count, name: F.when(count > 0, total(frame) - gone[0])})
    return out
