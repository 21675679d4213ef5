"""Table functions and the aggregate, called from SQL text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import tabular
from tablewright.operators import segments, sketches


@pytest.fixture(scope="module")
def sql(spark):
    tabular.register(spark)
    return spark.sql


def test_token_arrays(spark, sql):
    rows = [("q", p, 10 + p, 1, p % 3, p % 2) for p in (3, 0, 2, 1)] + [("r", 5, 7, 0, 0, 0)]
    spark.createDataFrame(rows, "question_id string, pos int, token_id int, segment_id int, column_id int, row_id int").repartition(3).createOrReplaceTempView("tok")
    got = {r["question_id"]: r for r in sql("SELECT * FROM token_arrays(TABLE(tok), length => 3)").collect()}
    assert (got["q"]["token_ids"], got["q"]["column_ids"], got["q"]["input_mask"], got["q"]["lost"]) == ([10, 11, 12], [0, 1, 2], [1, 1, 1], 1)
    assert (got["r"]["token_ids"], got["r"]["input_mask"], got["r"]["lost"]) == ([7, 0, 0], [1, 0, 0], 0)
    for bad in ("SELECT * FROM token_arrays(TABLE(tok), length => 0)", "SELECT * FROM token_arrays(TABLE(SELECT 1 AS question_id), length => 3)"):
        with pytest.raises(Exception, match="length|missing"):
            sql(bad).collect()


def test_token_arrays_of_whole_questions(spark, sql):
    """One call for each question, with the rows of one call for each token; null ids and tokens, and more tokens than fit."""
    rows = [(q, 7 * p % 11, None if p == 4 else 10 * p, p % 2, p % 3, p % 5) for q, n in (("a", 1), ("b", 11), (None, 6), ("d", 3)) for p in range(n)]
    tokens = spark.createDataFrame(rows, "question_id string, pos int, token_id int, segment_id int, column_id int, row_id int").repartition(3)
    tokens.createOrReplaceTempView("tok")
    tabular.whole_questions(tokens, 3).createOrReplaceTempView("whole")
    one = "SELECT a.* FROM whole, LATERAL token_arrays(question_id, n_tokens, token_id, segment_id, column_id, row_id, length => {}) a"
    for length in (2, 3):
        got, want = (sorted(map(tuple, sql(q).collect()), key=repr) for q in (one.format(length), f"SELECT * FROM token_arrays(TABLE(tok), length => {length})"))
        assert got == want and len(got) == 4 and [r[-1] for r in got if r[0] == "b"] == [11 - length]
    assert max(r["n"] for r in spark.table("whole").selectExpr("size(token_id) as n").collect()) == 3
    with pytest.raises(Exception, match="arrays token_id"):
        sql("SELECT a.* FROM whole, LATERAL token_arrays(question_id, n_tokens, length => 3) a").collect()


def test_table_cells(spark, sql):
    tables = [("a", json.dumps({"columns": ["x", "y"], "rows": [["1", 2], ["3"]]})), ("b", "no json"), ("c", None), ("d", json.dumps({"columns": [], "rows": [[]]}))]
    spark.createDataFrame(tables, "id string, j string").createOrReplaceTempView("tabs")
    got = sql("SELECT id, row_index, column_name, text FROM tabs, LATERAL table_cells(j)").collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 0, "x", "1"), ("a", 0, "y", "2"), ("a", 1, "x", "3"), ("a", 1, "y", None)]


def test_weighted_median(spark, sql):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([None, *map(float, range(9))]), rng.choice([None, 0.0, -1.0, 1.0, 2.0])) for _ in range(200)] + [("none", 1.0, 0.0)]
    spark.createDataFrame(rows, "g string, v double, w double").createOrReplaceTempView("vals")
    for g, m in sql("SELECT g, weighted_median(v, w) FROM vals GROUP BY g").collect():
        mine = sorted((v, w) for k, v, w in rows if k == g and v is not None and w is not None and w > 0)
        total, run, want = sum(w for _, w in mine), 0.0, None
        for v, w in mine:
            run += w
            if run >= total / 2:
                want = v
                break
        assert m == want


@pytest.mark.parametrize("exclude", ["current row", "group", "ties"])
@pytest.mark.parametrize("preceding, following", [(None, None), (2, 1), (None, 0), (-1, 2), (0, 0)])
def test_frames_with_exclusion(spark, exclude, preceding, following):
    rng = random.Random(7)
    rows = [(i, rng.choice("xy"), rng.randint(0, 4), rng.choice([None, 1, 2, 4, 8])) for i in range(60)]
    df = segments.excluding(spark.createDataFrame(rows, "i int, g string, o int, v int"), ["g"], ["o"], {"s": F.col("v")}, preceding, following, exclude, then=("i",))
    got = {r["i"]: (r["s"], r["s_n"]) for r in df.collect()}
    for g in "xy":
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(mine):
            low, high = 0 if preceding is None else max(0, k - preceding), len(mine) if following is None else k + following + 1
            frame = [(j, x) for j, x in enumerate(mine) if low <= j < high]
            gone = {"current row": lambda j, x: j == k, "group": lambda j, x: x[2] == r[2], "ties": lambda j, x: x[2] == r[2] and j != k}[exclude]
            left = [x[3] for j, x in frame if not gone(j, x) and x[3] is not None]
            assert got[r[0]] == (sum(left) if left else None, len(left))


def test_sketches_keep_their_errors_when_merged(spark):
    """200,000 rows over 20 days, 60,000 items: merged sketches against exact results."""
    df = spark.range(200_000).select(F.expr("date_add(date'2024-01-01', int(id % 20))").alias("at"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), (F.col("id") * 7919 % 60_000).alias("item"), F.pmod(F.xxhash64("id"), F.lit(1_000)).cast("double").alias("v"))
    days = sketches.by_day(df, "at", ["k"], "item", "v")
    assert days.count() == 40
    whole = sketches.rolled_up(days, []).first()
    exact = df.agg(F.count_distinct("item").alias("d")).first()["d"]
    assert whole["n"] == 200_000 and abs(whole["distinct"] - exact) <= sketches.hll_error() * exact and abs(whole["distinct_theta"] - exact) <= sketches.theta_error() * exact
    for q in (50, 90):
        rank = df.where(F.col("v") <= whole[f"q{q}"]).count() / 200_000
        assert abs(rank - q / 100) <= sketches.kll_error() + 0.001
    sides = {k: {r["item"] for r in df.where(F.col("k") == k).select("item").distinct().collect()} for k in "ab"}
    both = sketches.overlap(days, "k", "a", "b").first()
    for got, want in zip(both, (sides["a"] | sides["b"], sides["a"] & sides["b"], sides["a"] - sides["b"])):
        assert abs(got - len(want)) <= sketches.theta_error() * len(sides["a"] | sides["b"])
    none = sketches.rolled_up(sketches.by_day(df.limit(0), "at", ["k"], "item", "v"), ["k"])
    assert none.count() == 0


def test_overlaps_of_large_sets_are_exact(spark):
    """Past the sketches' 2 ** 14 items, and with a null item; a union of sketches keeps their size."""
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), (F.col("id") % 50_000).alias("item"))
    df = df.union(spark.createDataFrame([("a", None), (None, 1)], "k string, item long"))
    sides = {k: {r["item"] for r in df.where(F.col("k") == k).select("item").distinct().collect()} for k in "ab"}
    want = (len(sides["a"] | sides["b"]), len(sides["a"] & sides["b"]), len(sides["a"] - sides["b"]))
    assert tuple(sketches.exact_overlap(df, "k", "item", "a", "b").first()) == want
    assert tuple(sketches.exact_overlap(df.limit(0), "k", "item", "a", "b").first()) == (0, 0, 0)
    days = sketches.by_day(df.where("item < 9000").selectExpr("date'2024-01-01' as at", "k", "item", "1.0 as v"), "at", ["k"], "item", "v")
    assert sketches.overlap(days, "k", "a", "b").first()["either"] == 9_000


def test_cube_tells_nulls_from_totals(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "p string, q string, v int")
    got = {(r["p"], r["q"], r["level"]): r["v"] for r in sketches.cubed(df, ["p", "q"], {"v": F.sum("v")}).collect()}
    assert got == {("a", "null", 0): 1, ("a", "x", 0): 2, ("null", "x", 0): 4, ("a", "ALL", 1): 3, ("null", "ALL", 1): 4, ("ALL", "null", 2): 1, ("ALL", "x", 2): 6, ("ALL", "ALL", 3): 7}
