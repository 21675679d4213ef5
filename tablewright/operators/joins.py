"""Joins by order: the nearest row before or after, points in intervals, overlaps, bands, and totals of all rows below.

All of them cut the ordered column into ranges of about equal numbers of rows, so a key that holds most rows, or a join
without keys, is work for many tasks: rows meet inside a range, and what a range must know of the others (its last row,
its total) is one row for each key and range, which is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Cuts:
    """Ranges of about equal numbers of rows of one ordered column (numbers, dates or times) over several tables."""

    def __init__(self, sides: list[tuple[DataFrame, str]], ranges: int | None = None):
        ranges = ranges or int(sides[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.edges: list[float] = []
        if ranges > 1:
            one = sides[0][0].select(self.number(*sides[0]).alias("_x"))
            for side in sides[1:]:
                one = one.unionAll(side[0].select(self.number(*side).alias("_x")))
            found = one.agg(F.percentile_approx("_x", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
            self.edges = sorted(set(found or []))

    @staticmethod
    def number(df: DataFrame, column: str) -> Column:
        kind = dict(df.dtypes)[column]
        timed = kind.startswith("timestamp") or kind == "date"
        return (F.unix_micros(F.col(column).cast("timestamp")) if timed else F.col(column)).cast("double")

    def of(self, df: DataFrame, column: str) -> Column:
        """The range (from 0) of each value, by a binary search; null for a null."""
        x = self.number(df, column)

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(x < self.edges[middle], search(low, middle)).otherwise(search(middle + 1, high))

        return F.when(x.isNotNull(), search(0, len(self.edges)))


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], tolerance: Column | None = None, *,
    direction: str = "backward", exact: bool = True, ranges: int | None = None,
) -> DataFrame:
    """Each left row with the ``values`` of one right row of its key; null without one.

    ``backward`` takes the last right row that is not later, ``forward`` the first that is not earlier, ``nearest`` the
    closer of the two, the earlier of equals. Without ``exact`` a row of the same time does not count. ``tolerance``, an
    interval or a number, bounds the distance. Of right rows of one time the greatest by ``values`` counts. Null keys and
    null times meet nothing. No pair of rows ever arises: rows are sorted inside their key and range, next to the last
    (first) row of the ranges before (after) it.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    cuts = Cuts([(left, at), (right, at)], ranges)
    sides = {"backward": [True], "forward": [False], "nearest": [True, False]}[direction]
    one = right.where(known).groupBy(*keys, at).agg(F.max(F.struct(*values)).alias("_v"))
    seen = F.struct(F.col(at).alias("at"), F.col("_v").alias("v"))
    r = one.select(*keys, F.col(at).alias("_at"), cuts.of(one, at).alias("_range"), seen.alias("_seen"))
    row = F.struct(*left.columns)
    l = left.where(known).select(*keys, F.col(at).alias("_at"), cuts.of(left, at).alias("_range"), row.alias("_row"))
    places = l.select(*keys, "_range").distinct()
    rows = l.withColumn("_seen", F.lit(None).cast(r.schema["_seen"].dataType)).withColumn("_kind", F.lit(1))
    blank = lambda df, kind: df.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)).withColumn("_kind", F.lit(kind))
    rows = rows.unionByName(blank(r, 0))
    for backward in sides:
        # of the ranges before (after) a range, the last (first) right row of each key: a row for each key and range
        ends = r.groupBy(*keys, "_range").agg((F.max if backward else F.min)("_seen").alias("_end"))
        order = Window.partitionBy(*keys).orderBy("_range" if backward else F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        carried = places.join(ends, [*keys, "_range"], "full").withColumn("_seen", F.last("_end", ignorenulls=True).over(order))
        carried = carried.where("_seen is not null").select(*keys, F.col("_seen.at").alias("_at"), "_range", "_seen")
        rows = rows.unionByName(blank(carried, 0))
    # right rows of the same time come first if they count; a carried row lies outside its range, so it is never nearer
    side = F.col("_kind") if exact else -F.col("_kind")
    group = Window.partitionBy(*keys, "_range")
    found = {b: F.last("_seen", ignorenulls=True).over(group.orderBy(F.col("_at") if b else F.desc("_at"), side).rowsBetween(Window.unboundedPreceding, 0)) for b in sides}
    met = rows.withColumns({f"_{'before' if b else 'after'}": c for b, c in found.items()}).where("_kind = 1")
    distance = {"_before": F.col("_at") - F.col("_before.at"), "_after": F.col("_after.at") - F.col("_at")}
    names = [f"_{'before' if b else 'after'}" for b in sides]
    for n in names:
        if tolerance is not None:
            met = met.withColumn(n, F.when(distance[n] <= tolerance, F.col(n)))
    if len(names) == 2:
        chosen = F.when(F.col("_after").isNull() | (distance["_before"] <= distance["_after"]), F.col("_before")).otherwise(F.col("_after"))
    else:
        chosen = F.col(names[0])
    out = met.select("_row", chosen.alias("_s")).select("_row.*", *[F.col(f"_s.v.{v}").alias(v) for v in values])
    alone = left.where(~F.coalesce(known, F.lit(False)))
    kinds = {v: right.schema[v].dataType for v in values}
    return out.unionByName(alone.select(*left.columns, *[F.lit(None).cast(kinds[v]).alias(v) for v in values]))


def points_in_intervals(intervals: DataFrame, points: DataFrame, keys: list[str], begin: str, end: str, at: str, width: float | None = None, ranges: int | None = None) -> DataFrame:
    """Inner join of points to the intervals ``[begin, end]`` (both in) of their key that hold them.

    Time is cut into bins, of ``width`` seconds or, without one, by the points' quantiles; an interval is in every bin
    it touches, a point in one, so a hot key is spread over its bins and the join is an equality. Points that an interval
    meets in vain lie in its first and last bin. Intervals that end before they begin hold nothing.
    """
    if width is not None:
        bin_of = lambda df, c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(int(width * 1_000_000)))
    else:
        bin_of = Cuts([(points, at)], ranges).of
    valid = intervals.where(F.col(begin) <= F.col(end))
    spans = valid.withColumn("_bin", F.explode(F.sequence(bin_of(valid, begin), bin_of(valid, end))))
    return spans.join(points.withColumn("_bin", bin_of(points, at)), [*keys, "_bin"]).where(F.col(at).between(F.col(begin), F.col(end))).drop("_bin")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], ranges: int | None = None) -> DataFrame:
    """All pairs of a key whose intervals ``[begin, end]`` share a point, each once.

    Of two intervals that overlap, either the right one begins inside the left one, or the left one begins inside the
    right one and later than it: two joins of points to intervals, by whose work grows with the pairs that there are.
    """
    (lb, le), (rb, re) = left_span, right_span
    l, r = left.where(F.col(lb) <= F.col(le)), right.where(F.col(rb) <= F.col(re))
    inside = points_in_intervals(l, r, keys, lb, le, rb, ranges=ranges)
    later = points_in_intervals(r, l, keys, rb, re, lb, ranges=ranges).where(F.col(lb) > F.col(rb))
    return inside.unionByName(later.select(*inside.columns))


def band(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, below, above, ranges: int | None = None) -> DataFrame:
    """All pairs of a key with ``left_at - below <= right_at <= left_at + above``; numbers, or times and intervals."""
    wide = left.withColumns({"_low": F.col(left_at) - below, "_high": F.col(left_at) + above})
    return points_in_intervals(wide, right, keys, "_low", "_high", right_at, ranges=ranges).drop("_low", "_high")


def totals_below(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, exact: bool = False, ranges: int | None = None) -> DataFrame:
    """Each left row with ``n_below`` and ``total_below``, count and sum over the right rows of its key whose ``at`` is less.

    The aggregate of an inequality join without its pairs: prefix totals inside a range, on top of the totals of the
    ranges below. ``exact`` counts equals too. Null keys and null ``at`` meet nothing.
    """
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    cuts = Cuts([(left, at), (right, at)], ranges)
    r = right.where(known).groupBy(*keys, at).agg(F.count("*").alias("_n"), F.sum(value).alias("_t"))
    r = r.select(*keys, F.col(at).alias("_at"), cuts.of(r, at).alias("_range"), "_n", "_t")
    l = left.where(known).select(*keys, F.col(at).alias("_at"), cuts.of(left, at).alias("_range"), F.struct(*left.columns).alias("_row"))
    sums = r.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = l.select(*keys, "_range").distinct().join(sums, [*keys, "_range"], "full")
    carried = carried.withColumns({"_bn": F.sum("_n").over(before), "_bt": F.sum("_t").over(before)}).where("_bn is not null")
    carried = carried.select(*keys, F.lit(None).cast(r.schema["_at"].dataType).alias("_at"), "_range", F.col("_bn").alias("_n"), F.col("_bt").alias("_t"))
    rows = r.unionByName(carried).withColumn("_kind", F.lit(0)).unionByName(l.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    side = F.col("_kind") if exact else -F.col("_kind")
    w = Window.partitionBy(*keys, "_range").orderBy(F.col("_at").asc_nulls_first(), side).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumns({"n_below": F.coalesce(F.sum("_n").over(w), F.lit(0)), "total_below": F.sum("_t").over(w)}).where("_kind = 1")
    alone = left.where(~F.coalesce(known, F.lit(False))).withColumn("n_below", F.lit(0).cast("long"))
    return met.select("_row.*", "n_below", "total_below").unionByName(alone, allowMissingColumns=True)
