"""Ordered joins against plain Python, on odd rows, and on one key that holds them all."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.operators import joins


def nearest(l, right, direction, exact, tolerance):
    k, at = l
    if k is None or at is None:
        return None
    best = None
    for rk, rat, v in right:
        if rk != k or rat is None or (rat == at and not exact):
            continue
        way = at - rat
        if (direction == "backward" and way < 0) or (direction == "forward" and way > 0) or (tolerance is not None and abs(way) > tolerance):
            continue
        key = (-abs(way), way, v)  # the nearest, the earlier of equals, the greatest value
        best = max(best, (key, v)) if best is not None else (key, v)
    return None if best is None else best[1]


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(4)
    key = lambda: rng.choice(["a"] * 8 + ["b", "c", None])
    at = lambda: rng.choice([None, *range(0, 60)])
    return [(key(), at()) for _ in range(150)], [(key(), at(), rng.randint(0, 9)) for _ in range(120)]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact, tolerance, ranges", [(True, None, 6), (False, 4, 6), (True, 2, 1), (False, None, 40)])
def test_as_of(spark, sides, direction, exact, tolerance, ranges):
    left, right = sides
    l, r = spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    got = joins.as_of(l, r, ["k"], "t", ["v"], None if tolerance is None else F.lit(tolerance), direction=direction, exact=exact, ranges=ranges)
    want = [(*x, nearest(x, right, direction, exact, tolerance)) for x in left]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_as_of_empty_sides_and_times(spark):
    day = datetime(2024, 1, 1)
    l = spark.createDataFrame([("a", day + timedelta(hours=h)) for h in (1, 5, 9)], "k string, t timestamp")
    r = spark.createDataFrame([("a", day + timedelta(hours=h), h) for h in (0, 4, 11)], "k string, t timestamp, v int")
    values = lambda df: [x["v"] for x in df.orderBy("t").collect()]
    assert values(joins.as_of(l, r, ["k"], "t", ["v"], ranges=3)) == [0, 4, 4]
    assert values(joins.as_of(l, r, ["k"], "t", ["v"], F.expr("interval 1 hour"), ranges=3)) == [0, 4, None]
    assert values(joins.as_of(l, r, ["k"], "t", ["v"], direction="nearest", ranges=3)) == [0, 4, 11]
    assert values(joins.as_of(l, r.limit(0), ["k"], "t", ["v"])) == [None] * 3 and joins.as_of(l.limit(0), r, ["k"], "t", ["v"]).count() == 0
    with pytest.raises(ValueError):
        joins.as_of(l, r, ["k"], "t", ["v"], direction="up")


def test_one_key_is_many_tasks(spark):
    """Every row has one key: no sorted group has more than a few times its share of the rows."""
    n, ranges = 40_000, 16
    l = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    r = spark.range(0, n, 3).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    cuts = joins.Cuts([(l, "t"), (r, "t")], ranges)
    sizes = [x["count"] for x in l.groupBy(cuts.of(l, "t").alias("range")).count().collect()]
    assert len(sizes) == ranges and max(sizes) < 2 * n / ranges
    out = joins.as_of(l, r, ["k"], "t", ["v"], ranges=ranges)
    assert out.where("v = t - t % 3").count() == n
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(k#" in plan and "_range#" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("ranges", [1, 7])
def test_overlaps_bands_and_totals(spark, ranges):
    rng = random.Random(9)
    span = lambda: (b := rng.randint(0, 40), b + rng.randint(-2, 12))
    left = [(i, rng.choice("xy"), *span()) for i in range(70)] + [(200, None, 0, 9), (201, "x", None, 3), (202, "x", 0, 60)]
    right = [(i, rng.choice("xxy"), *span()) for i in range(60)] + [(300, None, 0, 9), (301, "x", 5, None), (302, "x", 5, 5)]
    l, r = spark.createDataFrame(left, "a int, k string, lb int, le int"), spark.createDataFrame(right, "b int, k string, rb int, re int")
    ok = lambda s: s[1] is not None and s[2] is not None and s[3] is not None and s[2] <= s[3]
    want = sorted((x[0], y[0]) for x in left for y in right if ok(x) and ok(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    got = joins.overlaps(l, r, ["k"], ("lb", "le"), ("rb", "re"), ranges=ranges)
    assert sorted((x["a"], x["b"]) for x in got.collect()) == want
    near = joins.band(l, r, ["k"], "lb", "rb", 2, 3, ranges=ranges)
    known = lambda s: s[1] is not None and s[2] is not None
    assert sorted((x["a"], x["b"]) for x in near.collect()) == sorted((x[0], y[0]) for x in left for y in right if known(x) and known(y) and x[1] == y[1] and x[2] - 2 <= y[2] <= x[2] + 3)
    for exact in (False, True):
        below = joins.totals_below(l.withColumnRenamed("lb", "t"), r.withColumnRenamed("rb", "t"), ["k"], "t", "b", exact=exact, ranges=ranges)
        hits = lambda x: [y[0] for y in right if known(x) and known(y) and x[1] == y[1] and (y[2] < x[2] or exact and y[2] == x[2])]
        assert sorted((x["a"], x["n_below"], x["total_below"]) for x in below.collect()) == sorted((x[0], len(hits(x)), sum(hits(x)) if hits(x) else None) for x in left)
