"""Cubes, and sketches that are stored by day and merged: distinct counts, overlaps of sets, quantiles.

A sketch has a bounded size whatever it counts, and the sketch of a union comes from the sketches of its parts. So a day
is read once, and any span of days or set of groups is answered from rows of a few kilobytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithms of the sizes of distinct-count sketches, and the size of quantile sketches.
HLL_BITS, THETA_BITS, KLL_SIZE = 14, 14, 400


def hll_error(bits: int = HLL_BITS, deviations: float = 3.0) -> float:
    """The relative error that a distinct count keeps with the probability of so many standard deviations."""
    return deviations * 1.04 / math.sqrt(1 << bits)


def theta_error(bits: int = THETA_BITS, deviations: float = 3.0) -> float:
    """The same for theta sketches; of an overlap or a difference it is relative to the sets' union."""
    return deviations / math.sqrt((1 << bits) - 1)


def kll_error(size: int = KLL_SIZE) -> float:
    """The difference in rank, as a share of all rows, that a quantile keeps with a probability of 0.99."""
    return 2.296 / size**0.9021


def cubed(df: DataFrame, dims: list[str], metrics: dict[str, Column], total: str = "ALL") -> DataFrame:
    """Metrics for every combination of values of ``dims``, of some of them, and of none; ``total`` stands for all values.

    A null value of a dimension is the text ``null``, so it is not taken for a total. ``level`` tells which dimensions
    are totals: a bit for each, the last dimension's the least. One expansion and one aggregation.
    """
    shown = df.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("null")) for d in dims})
    names = [F.when(F.grouping(d) == 1, F.lit(total)).otherwise(F.col(d)).alias(f"_{d}") for d in dims]
    out = shown.cube(*dims).agg(F.grouping_id(*dims).cast("int").alias("level"), *names, *[c.alias(n) for n, c in metrics.items()])
    return out.select(*[F.col(f"_{d}").alias(d) for d in dims], "level", *metrics)


def by_day(df: DataFrame, at: str, keys: list[str], item: str, value: str) -> DataFrame:
    """A row for each day and key: ``n``, ``total``, ``items`` (HLL), ``item_set`` (theta) and ``ranks`` (KLL); null items and values do not count."""
    return df.groupBy(F.to_date(at).alias("day"), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.hll_sketch_agg(item, HLL_BITS).alias("items"),
        F.theta_sketch_agg(item, THETA_BITS).alias("item_set"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("ranks"),
    )


def rolled_up(days: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """``by_day`` rows merged over days and all keys but ``keys``: ``n, total, distinct, distinct_theta`` and a column ``q50`` ... for each quantile."""
    merged = days.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("items").alias("_i"), F.theta_union_agg("item_set", THETA_BITS).alias("_s"), F.kll_merge_agg_double("ranks", KLL_SIZE).alias("_r")
    )
    at = [F.kll_sketch_get_quantile_double("_r", F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles]
    return merged.select(*keys, "n", "total", F.hll_sketch_estimate("_i").alias("distinct"), F.round(F.theta_sketch_estimate("_s")).cast("long").alias("distinct_theta"), *at)


def overlap(days: DataFrame, key: str, left, right) -> DataFrame:
    """One row ``either, both, only_left``: distinct items of two values of ``key`` over all days, from their merged sets."""
    side = lambda v, n: days.where(F.col(key) == v).agg(F.theta_union_agg("item_set", THETA_BITS).alias(n))
    met = side(left, "_l").crossJoin(side(right, "_r"))  # a row with a row
    count = lambda c: F.round(F.theta_sketch_estimate(c)).cast("long")
    return met.select(count(F.theta_union("_l", "_r", THETA_BITS)).alias("either"), count(F.theta_intersection("_l", "_r")).alias("both"), count(F.theta_difference("_l", "_r")).alias("only_left"))


def exact_overlap(df: DataFrame, key: str, item: str, left, right) -> DataFrame:
    """The row of :func:`overlap`, exact for sets of any size: one shuffle of a row for each item and task; null is an item of its own."""
    side = lambda v: F.coalesce(F.bool_or(F.col(key) == v), F.lit(False))
    met = df.where(F.col(key).isin(left, right)).groupBy(item).agg(side(left).alias("_l"), side(right).alias("_r"))
    return met.agg(F.count("*").alias("either"), F.count_if(F.col("_l") & F.col("_r")).alias("both"), F.count_if(F.col("_l") & ~F.col("_r")).alias("only_left"))
