import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import clusters, dedup, evaluate, layout, match, query, retrieval, segments, synth
from tablewright.schema import NUMERIC, TABLE, from_cells, rectangular, to_cells, wide_to_cells


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "Text string, Number double")


def answer(df, select, agg, *where):
    return query.TableQuery(select, agg, where).answer(df).first()["answer"]


def test_structured_queries(letters):
    c = query.Condition
    assert [r["Text"] for r in query.TableQuery("Text", where=(c("Number", "=", 2),)).rows(letters).collect()] == ["B"]
    assert answer(letters, "Number", "SUM", c("Number", ">", 1)) == 5.0
    assert answer(letters, "Number", "COUNT", c("Number", ">", 9)) == 0.0
    assert math.isnan(answer(letters, "Number", "AVERAGE", c("Number", ">", 9)))
    assert answer(letters, "Text", "SUM") is None
    assert [r["Text"] for r in query.TableQuery("Text", where=(c("Text", ">", "a"),)).rows(letters).collect()] == ["B", "C"]
    with pytest.raises(TypeError):
        query.TableQuery("Text", where=(c("Text", "=", 3),)).rows(letters)


def test_extremes_take_first_least_and_last_greatest(spark):
    df = spark.createDataFrame([("g", 1, 0), ("g", 1, 1), ("g", 5, 2), ("g", 5, 3)], "k string, v int, p int")
    assert query.extreme_cell(df, ["k"], "v", "p", False).first()["position"] == 0
    assert query.extreme_cell(df, ["k"], "v", "p", True).first()["position"] == 3


def test_errors_outweigh_false(spark):
    df = spark.createDataFrame([(True, None), (False, None), (False, True), (True, True)], "a boolean, b boolean")
    assert [r[0] for r in df.select(query.all_hold([F.col("a"), F.col("b")])).collect()] == [None, None, False, True]
    sets = spark.createDataFrame([([1, 2], [3]), ([], [1]), ([1, 1], [1])], "l array<int>, r array<int>")
    assert [r[0] for r in sets.select(query.compare_sets(F.col("l"), F.col("r"), "<")).collect()] == [True, None, False]
    assert [r[0] for r in sets.select(query.compare_sets(F.col("l"), F.col("r"), "=")).collect()] == [False, None, True]


def test_where_number_aborts_on_text(spark):
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    assert query.where_number(df, "t", ">", 0).count() == 0
    assert query.where_number(df.where("t = '1'"), "t", ">", 0).count() == 1


def test_tables_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    cells = wide_to_cells(df, F.lit("t"), ["n"], ["n", "s"])
    nested = from_cells(cells)
    assert rectangular(nested).count() == 1
    back = to_cells(nested).select(cells.columns)
    assert sorted(back.collect()) == sorted(cells.collect())


def test_ranks_ignore_nulls(spark):
    df = spark.createDataFrame([("c", 3.0), ("c", None), ("c", 1.0), ("c", 3.0)], "g string, v double")
    assert sorted((r["v"] or 0, r["rank"], r["inverse_rank"]) for r in segments.ranks(df, ["g"], "v").collect()) == [(0, 0, 0), (1.0, 1, 2), (3.0, 2, 1), (3.0, 2, 1)]


def test_type_vote(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, 0), ("b", 0, 0), ("c", 1, 0), ("c", 1, 0)], "k string, n int, d int")
    assert {r["k"]: r["type"] for r in segments.type_vote(df, ["k"], F.col("n") == 1, F.col("d") == 1).collect()} == {"a": "date", "b": None, "c": "number"}


def test_islands_and_empty_segments(spark):
    df = spark.createDataFrame([("u", i, float(p)) for i, p in enumerate([9, 9, 1, 9, 4])], "u string, t int, p double")
    assert sorted((r["begin"], r["end"], round(r["score"], 6)) for r in segments.islands(df, ["u"], ["t"], F.col("p") > 3, F.col("p")).collect()) == [(1, 2, 9.0), (4, 5, 6.0)]
    s = segments.reduce_segments(df.withColumn("s", F.lit(1)), "u", "s", "p", 2).collect()
    assert sorted((r["s"], r["total"]) for r in s) == [(0, 0.0), (1, 32.0)]


def test_bm25_and_cosine(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "y z"), (3, "w"), (4, "v u"), (5, "t")], "id int, text string")
    asks = spark.createDataFrame([(9, "x y")], "q int, text string")
    words = F.split("text", " ")
    index = retrieval.bm25_index(docs, "id", words)
    top = retrieval.best(retrieval.lookup(retrieval.asked_terms(asks, "q", words), "q", index, "id", "weight"), "q", "id", 5).collect()
    assert [r["id"] for r in sorted(top, key=lambda r: r["rank"])] == [1, 2]
    vectors, idf = retrieval.tfidf_index(docs, "id", words)
    assert retrieval.best(retrieval.cosine(retrieval.asked_terms(asks, "q", words), "q", vectors, idf, "id"), "q", "id", 1).first()["score"] == pytest.approx(1.0)


def test_negatives_skip_gold(spark):
    ranked = spark.createDataFrame([("q", d, r) for r, d in enumerate("abcd")], "q string, d string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("q", "c")], "q string, d string")
    assert [(r["d"], r["place"]) for r in retrieval.hard_negatives(ranked, "q", "d", gold, 5).orderBy("place").collect()] == [("b", 0), ("d", 1)]


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), ([], []), ([], ["a"]), (["a"], ["b"])], "g array<string>, p array<string>")
    assert [round(r[0], 6) for r in df.select(evaluate.token_f1(F.col("g"), F.col("p"))).collect()] == [0.666667, 1.0, 0.0, 0.0]
    cells = spark.createDataFrame([("q1", "1"), ("q1", "2.5"), ("q2", "x"), ("q2", "3"), ("q3", None)], "q string, t string")
    total = {r["q"]: r["values"] for r in evaluate.denotation(cells, "q", "t", F.lit("SUM")).collect()}
    assert total == {"q1": ["3.5"], "q2": ["3.0", "x"], "q3": []}
    f1 = {r["label"]: r["f1"] for r in evaluate.f1_by_class(spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "g int, p int"), "g", "p").collect()}
    assert f1 == {0: pytest.approx(2 / 3), 1: pytest.approx(2 / 3)}


def test_similar_pairs_and_clusters(spark):
    df = spark.createDataFrame([("t", i, g) for i, g in enumerate([["a", "b", "c"], ["a", "b", "c"], ["a", "b", "x"], ["q"], []])], "k string, i int, g array<string>")
    pairs = dedup.similar_pairs(df, "k", "i", "g", 0.5)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(0, 1), (0, 2), (1, 2)]
    assert {(r["item"], r["cluster"]) for r in dedup.cluster(pairs, "k").collect()} == {(0, 0), (1, 0), (2, 0)}


def brute_groups(tables, threshold):
    """The clusters of one title by the definition: every pair of tables, every pair of cluster members."""
    vectors = {}
    for i, (key, header, rows, _) in enumerate(tables):
        x = np.zeros(2048)
        for line in [header, *rows]:
            tokens = [t for c in line for t in re.sub(r"\W", " ", c).lower().split()]
            for a in range(len(tokens)):
                for n in range(1, 5):
                    if a + n <= len(tokens):
                        x[int(hashlib.sha256(" ".join(tokens[a : a + n]).encode()).hexdigest(), 16) % 2048] += 1
        vectors.setdefault(key, (i, x))
    fit = lambda a, b: not set(a[3]) & set(b[3]) and abs(len(a[2]) - len(b[2])) <= 2 and len(a[1]) == len(b[1])
    pairs = []
    for a in sorted(vectors):
        for b in sorted(vectors):
            (i, x), (j, y) = vectors[a], vectors[b]
            if a < b and fit(tables[i], tables[j]) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                pairs.append((-(x @ y) / np.sqrt((x @ x) * (y @ y)), a, b))
    groups = {k: [t for t in tables if t[0] == k] for k in vectors}
    of = {k: k for k in vectors}
    for _, a, b in sorted(pairs):
        x, y = sorted((of[a], of[b]))
        if x != y and all(fit(s, t) for s in groups[x] for t in groups[y]):
            groups[x] += groups.pop(y)
            of = {k: x if v == y else v for k, v in of.items()}
    return of


@pytest.mark.parametrize("cut", [{}, {"small": 2, "strip": 5}])
def test_similar_tables_are_grouped_with_vetoes(spark, monkeypatch, cut):
    monkeypatch.setattr(clusters, "_STRIP", 7)
    rng = np.random.default_rng(3)
    tables = []
    for i in range(60):
        rows = [[f"w{(i % 4) * 50 + 3 * r + c} x" for c in range(2)] for r in range(10 + int(rng.integers(0, 4)))]
        if rng.random() < 0.6:
            rows[int(rng.integers(0, 8))][0] = f"Edit-{i % 7}"
        tables.append((f"t{i:02}", ["A", "B b"] if i % 9 else ["A"], rows, [f"u{int(rng.integers(0, 40))}", f"v{i}"]))
    tables += [("t03", tables[3][1], tables[3][2], ["u1", "v99"]), ("t90", ["?"], [[" "]], ["q"]), ("t91", ["?"], [[" "]], ["r"])]
    cell = lambda x: (x, None)
    data = [(k, [cell(c) for c in h], [([cell(c) for c in r],) for r in rows], "T" if k != "t91" else None, u[0], u[1:]) for k, h, rows, u in tables]
    df = spark.createDataFrame(data, T.StructType([*TABLE.fields, T.StructField("alternative_document_urls", T.ArrayType(T.StringType()))]))
    got = {(r["table_id"], r["document_url"]): r["cluster"] for r in clusters.group_similar_tables(df, **cut).collect()}
    want = brute_groups([t for t in tables if t[0] != "t91"], 0.91) | {"t91": "t91"}
    assert got == {(k, u[0]): want[k] for k, _, _, u in tables}
    free = brute_groups([(k, h, rows, []) for k, h, rows, _ in tables if k != "t91"], 0.91)
    assert 4 < len(set(want.values())) < 60 and len(set(free.values())) < len(set(want.values())) - 1


@pytest.mark.parametrize("second, wanted", [((["A"], "b"), ["a", "a"]), ((["B"], "b"), ["a", "b"]), ((["A"], "a"), ["a", "b"])])
def test_two_similar_tables(spark, second, wanted):
    one = lambda i, h, url: (i, [(c, None) for c in h], [([("a", None)],)], "T", url)
    df = spark.createDataFrame([one("a", ["A"], "a"), one("b", *second)], TABLE)
    assert [r["cluster"] for r in clusters.group_similar_tables(df, hash_dimension=16).orderBy("table_id").collect()] == wanted


def test_merging_in_rounds_equals_merging_in_order(spark):
    rng = np.random.default_rng(11)
    names = [f"u{i:02}" for i in range(12)]
    members = [(int(rng.integers(0, 4)), [f"d{int(rng.integers(0, 9))}"]) for _ in names]
    pairs = [(names[i], names[j], float(rng.integers(910, 1000)) / 1000) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.35]
    units = spark.createDataFrame([("k", n, r, r, u) for n, (r, u) in zip(names, members)], "key string, unit string, least int, most int, urls array<string>")
    got = {r["unit"]: r["cluster"] for r in clusters.merge_in_rounds(spark.createDataFrame([("k", *p) for p in pairs], "key string, a string, b string, cosine double"), units, "key").collect()}
    at = {n: i for i, n in enumerate(names)}
    want = clusters._merged(names, [clusters._Members(u, r, r) for r, u in members], [at[p[0]] for p in pairs], [at[p[1]] for p in pairs], [p[2] for p in pairs])
    assert got == dict(zip(names, want)) and 2 < len(set(want)) < 12
    assert clusters._merged(names, [clusters._Members([], 0, 0) for _ in names], [at[p[0]] for p in pairs], [at[p[1]] for p in pairs], [1.0] * len(pairs)) != want


def test_many_near_copies_of_one_title(spark):
    """3,000 tables of one title, 2,500 of them equal in 1,250 documents twice: cells, components, no pair of equals."""
    rows = [(f"t{i:05}", f"u{i // 2 if i < 2500 else i}", [f"w{k}" for k in range(20)] + ([] if i < 2500 else [f"x{i % 40}"])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "table_id string, document_url string, words array<string>").repartition(4)
    cell = lambda x: F.struct(x.alias("text"), F.lit(None).cast(NUMERIC).alias("numeric_value"))
    tables = df.select("table_id", F.array(cell(F.lit("h"))).alias("columns"), F.transform("words", lambda w: F.struct(F.array(cell(w)).alias("cells"))).alias("rows"), F.lit("T").alias("document_title"), "document_url")
    got = {r["table_id"]: r["cluster"] for r in clusters.group_similar_tables(tables, small=8, strip=16).collect()}
    first, second = {got[f"t{i:05}"] for i in range(0, 2500, 2)}, {got[f"t{i:05}"] for i in range(1, 2500, 2)}
    assert len(first) == len(second) == 1 and first != second
    assert {got[f"t{i:05}"] for i in range(2500, 3000)} <= first | second


def test_locating_answers(spark):
    cells = spark.createDataFrame([("t", 0, 0, "Paris"), ("t", 1, 0, "café [1]"), ("t", 2, 0, "dup"), ("t", 3, 0, "dup")], "table_id string, row_index int, column_index int, text string")
    asks = spark.createDataFrame([("q", "t", "paris"), ("q", "t", "Cafe"), ("q", "t", "dup"), ("q", "t", "none")], "question_id string, table_id string, answer string")
    got = {r["answer"]: (r["row_index"], r["level"], r["ambiguous"]) for r in match.locate(asks, cells).collect()}
    assert got == {"paris": (0, 1, False), "Cafe": (1, 3, False), "dup": (2, 0, True)}


def test_sublists_and_subsets(spark):
    df = spark.createDataFrame([([2, 3], [1, 2, 3]), ([9], [1]), ([], [1])], "n array<int>, h array<int>")
    assert [r[0] for r in df.select(match.find_sublist(F.col("n"), F.col("h"))).collect()] == [1, None, None]
    grid = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 2.0), ("c", 2, 1.0)], "c string, r int, v double")
    find = lambda df, target, **how: {(tuple(r["rows"]), r["aggregation"]) for r in match.subsets(df, ["c"], "r", "v", F.lit(target), **how).collect()}
    assert find(grid, 3.0) == {((0, 1), "SUM"), ((1, 2), "SUM")} and find(grid, float("nan")) == find(grid, None) == set()
    many = spark.createDataFrame([("c", i, float(i)) for i in range(11)], "c string, r int, v double")
    got = find(many, 30.0)  # of eleven rows, in seeded draws of ten
    assert got and got == find(many.repartition(3), 30.0) and all(a == "SUM" and sum(rows) == 30 and len(rows) <= 10 for rows, a in got)
    assert len(find(many, 30.0, clip=5)) == 5 and find(many, 30.0, clip=5) <= got
    whole = {tuple(i for i in range(11) if m >> i & 1) for m in range(1, 1 << 11)}
    assert got == {(rows, "SUM") for rows in whole if sum(rows) == 30 and len(rows) <= 10}  # a hundred draws of ten meet them all


def test_counts_of_any_size_are_explained(spark):
    df = spark.createDataFrame([("a", i, 12) for i in range(14)] + [("b", i, 3) for i in range(3)] + [("c", 0, 2), ("d", 0, 0)], "g string, r int, t int")
    got = match.count_subsets(df, ["g"], "r", F.col("t")).collect()
    of = lambda g: [tuple(r["rows"]) for r in got if r["g"] == g]
    assert of("b") == [(0, 1, 2)] and not of("c") and not of("d")
    assert 40 < len(of("a")) <= 91 and len(set(of("a"))) == len(of("a")) and all(len(set(x)) == 12 and set(x) <= set(range(14)) for x in of("a"))
    assert not match.count_subsets(df.withColumn("t", F.lit(2.5)), ["g"], "r", F.col("t")).collect()


def test_shuffles_of_large_groups_are_made_in_many_tasks(spark, monkeypatch):
    """Thirty shuffles of 300 places: dealt by their number of places, and the same that the definition chooses."""
    monkeypatch.setattr(match, "DRAWN", 1_000)
    monkeypatch.setattr(match, "SENT", 400)
    df = spark.createDataFrame([("a", i, 200) for i in range(300)] + [("b", i, 2) for i in range(3)], "g string, r int, t int")
    out = match.count_subsets(df, ["g"], "r", F.col("t"), draws=30, seed=4, clip=12)
    head = lambda x: hashlib.md5(x.encode()).hexdigest()[:12]
    want = set()
    for g, n, t in (("a", 300, 200), ("b", 3, 2)):
        sets = {tuple(sorted(sorted(range(n), key=lambda i: (head(f"4|{g}|{d}|{i}"), i))[:t])) for d in range(1, 31)}
        want |= {(g, r, "COUNT", float(t)) for r in sorted(sets, key=lambda r: head("4|COUNT|" + ",".join(map(str, r))))[:12]}
    assert {(r["g"], tuple(r["rows"]), r["aggregation"], r["result"]) for r in out.collect()} == want
    assert out.rdd.getNumPartitions() >= 9


def test_large_groups_are_sampled_without_their_subsets_of_values(spark):
    """Of 5,000 rows only the sampled ones meet masks: at most ``draws`` picks of ten."""
    df = spark.range(5_000).select(F.lit("g").alias("g"), F.col("id").alias("r"), F.lit(1.0).alias("v"))
    got = match.subsets(df, ["g"], "r", "v", F.lit(3.0), draws=4, clip=10_000).collect()
    assert {len(r["rows"]) for r in got} == {3} and 400 <= len(got) <= 480 and max(max(r["rows"]) for r in got) > 2_000


@pytest.mark.parametrize("place, target, want", [
    (None, 3.0, {("COUNT", c, (0, 1, 2)) for c in range(3)} | {("SUM", 0, (0, 1)), ("SUM", 0, (1, 2)), ("SUM", 1, (0,)), ("SUM", 1, (0, 1)), ("AVERAGE", 1, (0,)), ("AVERAGE", 2, (0, 2))}),
    ((1, 0), 100.0, {("NONE", 0, (1,))}), (None, float("nan"), set()), (None, 2.5, set()),
])
def test_all_interpretations_of_a_number(spark, place, target, want):
    grid = [(1.0, 3.0, 6.0), (2.0, 0.0, None), (1.0, None, 0.0)]
    cells = spark.createDataFrame([("t", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "table_id string, row_index int, column_index int, value double")
    question = spark.createDataFrame([("q", "t", target, *(place or (None, None)))], "question_id string, table_id string, target double, row_index int, column_index int")
    assert {(r["aggregation"], r["column_index"], tuple(r["rows"])) for r in match.interpretations(cells, question).collect()} == want


@pytest.mark.parametrize("part_bytes", [1 << 20, 16])
def test_texts_sought_all_at_once_equal_brute_force(spark, part_bytes):
    import random

    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 300)))) for i in range(80)] + [(None, "ab"), (500, None), (-1, "é" * 200), (501, "")]
    cut = [d[a : a + rng.choice([1, 2, 3, 5, 17, 64, 70, 150])] for d in (docs[rng.randrange(80)][1] for _ in range(40)) if d for a in [rng.randrange(len(d))]]
    asks = [(i % 37, t) for i, t in enumerate([*cut, *cut[:5], "", None, "é" * 130, "zzz", "b" * 90])]
    got = match.containing(spark.createDataFrame(docs, "d long, t string").repartition(3), "d", "t", spark.createDataFrame(asks, "i int, s string"), "i", "s", part_bytes)
    met = [(i, d) for i, s in asks for d, t in docs if s is not None and t is not None and s in t]
    want = {(i, sum(j == i for j, _ in met), min((d for j, d in met if j == i and d is not None), default=None)) for i, _ in met}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 30


def test_pairs_by_prefixes_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    data = [(k, i, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))]) for k in "xy" for i in range(60)]
    df = spark.createDataFrame(data, "k string, i int, g array<string>")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r["k"], r["a"], r["b"]) for r in dedup.similar_pairs(df, "k", "i", "g", threshold).collect()}
        want = {(k, i, j) for k, i, g in data for m, j, h in data if k == m and i < j and set(g) and len(set(g) & set(h)) >= threshold * len(set(g) | set(h))}
        assert got == want and want


def test_pairs_of_many_copies_are_made_where_they_are_returned(spark, monkeypatch):
    """Three texts, 40 copies each: one pair of classes and three classes meet, in arrays of about 8 members."""
    monkeypatch.setattr(dedup, "CHUNK", 8)
    plain = {0: ["a", "b", "c", "d"], 1: ["d", "c", "b", "a", "e"], 2: ["x"]}
    df = spark.createDataFrame([("k", i, plain[i % 3]) for i in range(120)], "k string, i int, g array<string>")
    out = dedup.similar_pairs(df, "k", "i", "g", 0.8)
    got = [tuple(r) for r in out.select("a", "b", "na", "nb", "both", "similarity").collect()]
    alike = lambda i, j: i % 3 == j % 3 or {i % 3, j % 3} == {0, 1}
    size = lambda i: len(plain[i % 3])
    both = lambda i, j: min(size(i), size(j))
    assert sorted(got) == [(i, j, size(i), size(j), both(i, j), both(i, j) / (size(i) + size(j) - both(i, j))) for i in range(120) for j in range(i + 1, 120) if alike(i, j)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and "Generate" in plan  # sets are compared before, by class


def test_documents_are_counted_a_bounded_number_of_tokens_at_a_time():
    """No slice holds more tokens than stated, unless one document does; rows keep their order and none is lost."""
    import pyarrow as pa

    lists = [["a"] * n if n is not None else None for n in (3, 0, None, 4, 9, 1, 1, 1, 30, 0)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(lists, pa.list_(pa.string()))], names=["id", "_t"])
    for batch, ids in ((whole, list(range(10))), (whole.slice(3, 6), list(range(3, 9)))):
        parts = [x for x in retrieval._token_slices(batch, 8)]
        assert [i for x in parts for i in x.column("id").to_pylist()] == ids and len(parts) > 2
        assert all(x.num_rows == 1 or sum(len(t or ()) for t in x.column("_t").to_pylist()) <= 8 for x in parts)


def test_neighbours_of_sharded_points(spark):
    import random

    rng = random.Random(6)
    data = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(90)] + [(200, None)]
    df = spark.createDataFrame(data, "i long, v array<float>")
    asks = df.where("i < 7").withColumnRenamed("i", "q")
    got = {(r["q"], r["rank"], r["i"], r["score"]) for r in retrieval.neighbours(asks, "q", df, "i", "v", 5, shard_rows=20).collect()}
    want = set()
    for q, x in data[:7]:
        best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in data if v and i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want


def test_neighbours_hold_few_scores_at_a_time(spark, monkeypatch):
    """Blocks of one or two queries against a shard's points, in several batches, find what all scores at once do."""
    monkeypatch.setattr(retrieval, "SCORES", 40)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(70, 4)).round(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in retrieval.neighbours(df.withColumnRenamed("i", "q"), "q", df, "i", "v", 4, shard_rows=30).select("q", "rank", "i", "score").orderBy("q", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    scores = (v @ v.T).round(6)
    want = [(q, r + 1, i) for q in range(70) for r, i in enumerate(sorted((i for i in range(70) if i != q), key=lambda i: (-scores[q, i], i))[:4])]
    assert [g[:3] for g in got] == want


def test_neighbours_leave_unusable_vectors_out(spark):
    """38 good points and 40 with a null component, vectors of two lengths, and ones that are empty or not finite."""
    good = [(i, [float(i % 5), float(i % 7)]) for i in range(38)]
    bad = [(100 + i, [1.0, None]) for i in range(40)] + [(200, []), (201, [float("nan"), 1.0]), (202, [float("inf"), 0.0]), (203, None)]
    longer = [(300 + i, [1.0, 1.0, float(i)]) for i in range(5)]
    df = spark.createDataFrame(good + bad + longer, "i long, v array<double>")
    asks = df.where("i in (3, 100, 201, 203, 302)").withColumnRenamed("i", "q")
    got = [(r["q"], r["rank"], r["i"], r["score"]) for r in retrieval.neighbours(asks, "q", df, "i", "v", 30, shard_rows=16).orderBy("q", "rank").collect()]
    want = []
    for q, x in [good[3], longer[2]]:
        best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in (good if len(x) == 2 else longer) if i != q)[:30]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want and retrieval.neighbours(asks, "q", df.limit(0), "i", "v", 3).count() == 0


def test_noisy_cells_are_wrong_and_near(spark):
    cells = spark.createDataFrame([("t", r, c) for r in range(3) for c in range(3)], "table_id string, row_index int, column_index int")
    truth = spark.createDataFrame([("t", 1, 1)], "table_id string, row_index int, column_index int")
    n = lambda s: match.noisy_cells(cells, truth, s, 99).count()
    assert (n("FULL"), n("SELECTIVE"), n("COLUMN")) == (8, 4, 2)


def test_layout(spark):
    cols = spark.createDataFrame([([(0, 1, 50), (1, 2, 60), (2, 3, 40)],)], "c array<struct<priority:int,id:bigint,cost:bigint>>")
    assert cols.select(layout.knapsack(F.col("c"), 100)).first()[0] == [1, 3]
    sizes = spark.createDataFrame([("t", 3), ("t", 10)], "t string, s int")
    assert layout.largest_length(sizes, ["t"], F.col("s"), 9).first()["length"] == 6
    assert layout.largest_length(sizes, ["t"], F.col("s"), 1).first()["length"] == 0
    tokens = spark.createDataFrame([("q", 1, 7, 0, 0, 0), ("q", 0, 5, 0, 0, 0)], "question_id string, pos int, token_id int, segment_id int, column_id int, row_id int")
    row = layout.features(tokens, 4).first()
    assert (row["token_ids"], row["input_mask"]) == ([5, 7, 0, 0], [1, 1, 0, 0])


def halves(begin, end, most):
    if end - begin <= most:
        return [(begin, end)]
    middle = begin + (end - begin) // 2
    return halves(begin, middle, most) + halves(middle, end, most)


def test_shards_halve_each_branch_until_it_fits(spark):
    shapes = [(n, c) for n in (0, 1, 2, 3, 5, 7, 9, 10, 17, 33, 100, 257) for c in (1, 2, 5, 7, 12, 25, 49, 50, 51)]
    rows = spark.createDataFrame(shapes, "n int, c int").select("n", "c", layout.shard_ranges(F.col("n"), F.col("c")).alias("s"), layout.shard_ranges(F.col("n"), F.col("c"), least=0).alias("all")).collect()
    for r in rows:
        want = halves(0, r["n"], 50 // r["c"]) if r["c"] <= 50 else []
        assert [tuple(x) for x in r["all"]] == want and [tuple(x) for x in r["s"]] == [x for x in want if x[1] - x[0] >= 2]
    assert {(r["n"], r["c"]): [tuple(x) for x in r["s"]] for r in rows}[5, 25] == [(0, 2), (3, 5)]
    assert {(r["n"], r["c"]): [tuple(x) for x in r["s"]] for r in rows}[9, 25] == [(0, 2), (2, 4), (4, 6), (7, 9)]


#: Relations of Q1 Q2 | A0 B0 C0 | A1 B1 C1 | A2 B2 C2 | four places of padding, row by row.
RELATED = """
12 12 11 11 11 10 10 10 10 10 10 0 0 0 0
12 12 11 11 11 10 10 10 10 10 10 0 0 0 0
9 9 8 7 7 6 0 0 6 0 0 0 0 0 0
9 9 7 8 7 0 6 0 0 6 0 0 0 0 0
9 9 7 7 8 0 0 6 0 0 6 0 0 0 0
5 5 4 0 0 3 1 1 2 0 0 0 0 0 0
5 5 0 4 0 1 3 1 0 2 0 0 0 0 0
5 5 0 0 4 1 1 3 0 0 2 0 0 0 0
5 5 4 0 0 2 0 0 3 1 1 0 0 0 0
5 5 0 4 0 0 2 0 1 3 1 0 0 0 0
5 5 0 0 4 0 0 2 1 1 3 0 0 0 0
"""


def test_relations_of_a_question_and_its_table(spark):
    want = [list(map(int, line.split())) for line in RELATED.strip().splitlines()] + [[0] * 15] * 4
    ids = ([0, 0, *[1] * 9, 0, 0, 0, 0], [0, 0, 1, 2, 3, 1, 2, 3, 1, 2, 3, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 0, 0, 0, 0], [1] * 11 + [0] * 4)
    df = spark.createDataFrame([ids, tuple(x[2:] for x in ids), ([0] * 5, [0] * 5, [0] * 5, [1, 1, 0, 0, 0])], "s array<int>, c array<int>, r array<int>, m array<int>")
    columns = [F.col(x) for x in "scrm"]
    both, table, text = [r[0] for r in df.select(layout.relations(*columns)).collect()]
    assert both == want and table == [row[2:] for row in want[2:]] and text == [[12, 12, 0, 0, 0]] * 2 + [[0] * 5] * 3
    less = df.limit(1).select(layout.relations(*columns, without="same_cell")).first()[0]
    assert less == [[0 if x == 3 else x for x in row] for row in want]
    assert df.select(layout.relations(*columns[:3])).collect()[2][0] == [[12] * 5] * 5


def test_cell_selection_counts_questions(spark):
    """Two questions: one with two gold cells, of which one is among three selected; one without gold cells or prediction."""
    tokens = spark.createDataFrame([("b", 0, 1, 1, 0.8), ("b", 1, 2, 1, 0.7), ("b", 2, 2, 3, 0.4), ("b", 3, 6, 5, 0.9)], "q string, at int, c int, r int, p double")
    best = evaluate.best_cells(tokens, "q", "r", "c", "p", "at")
    assert [tuple(x) for x in best.first()["cells"]] == [(5, 6), (1, 1), (1, 2), (3, 2)]
    mean = spark.createDataFrame([("q", 0, 1, 1, 0.8), ("q", 1, 1, 2, 0.7), ("q", 2, 3, 2, 0.4), ("q", 3, 1, 2, 1.0)], "q string, at int, c int, r int, p double")
    assert [tuple(x) for x in evaluate.best_cells(mean, "q", "r", "c", "p", "at").first()["cells"]] == [(2, 1), (1, 1), (2, 3)]
    schema = "q string, gold array<struct<row:int,column:int>>, selected array<struct<row:int,column:int>>, n_table int, n_text int"
    df = spark.createDataFrame([("a", [], None, 0, 0), ("b", [(5, 6), (2, 3)], [(5, 6), (1, 1), (1, 2)], 0, 2)], schema).join(best, "q", "left")
    df = df.withColumn("kind", evaluate.answer_type(F.col("n_table"), F.col("n_text")))
    got = {r["name"]: tuple(r)[2:] for r in evaluate.cell_selection(df, "kind", "gold", "selected", "cells").select("name", "n", "recall", "precision", "non_empty", "answer_len", "coverage", "recall_at_1", "recall_at_3", "recall_at_5").collect()}
    assert got == {"all": (0.5, 1 / 3, 0.5, 1.5, 0.5, 0.5, 0.5, 0.5), "2+_in_text": (1.0, 1 / 3, 1.0, 3.0, 1.0, 1.0, 1.0, 1.0), "no_answer": (0.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)}
    kinds = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 1), (2, 0), (0, 2)], "a int, b int").select(evaluate.answer_type(F.col("a"), F.col("b")))
    assert [r[0] for r in kinds.collect()] == ["table_&_text", "no_answer", "1_in_table", "1_in_text", "2+_in_table", "2+_in_text"]


def test_statements_of_a_table_with_two_cells_in_a_place(spark):
    cells = spark.createDataFrame([("t", 0, "a", "1,5"), ("t", 0, "a", "9"), ("t", 1, "a", "2")], "table_id string, row_index int, column_name string, text string")
    assert {r["statement"] for r in synth.statements(cells).collect() if r["label"]} <= {"the total a is 3.50", "the average a is 1.75", "the highest a is 2", "the lowest a is 1.50"}


def test_synthesis_is_seeded(spark):
    cells = wide_to_cells(spark.createDataFrame([(1, 2.0), (2, 4.0)], "a int, b double"), F.lit("t"), ["a"], ["a", "b"])
    first = sorted(synth.statements(cells).collect())
    assert first == sorted(synth.statements(cells.repartition(3)).collect()) and {r["label"] for r in first} == {0, 1}
    copies = synth.sample_copies(spark.range(1000), F.col("id"), F.lit(1.5)).count()
    assert 1400 < copies < 1600
    m = spark.createDataFrame([(list("abcdefghij" * 4), 1), ([], 2)], "t array<string>, k int").select(synth.masked_positions(F.col("t"), F.col("k")).alias("m")).collect()
    assert len(m[0]["m"]) == 6 and m[1]["m"] == []


def plain_grams(text, low, high, inside):
    text = " ".join(text.lower().split())
    if not inside:
        return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]
    out = []
    for w in (f" {w} " for w in text.split()):
        for n in range(low, high + 1):
            out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if n >= len(w):
                break
    return out


@pytest.mark.parametrize("low, high", [(1, 2), (2, 4), (5, 7)])
def test_search_by_characters(spark, low, high):
    texts = ["The  Cat", "a", "", "cats and dogs", "\u00c9t\u00e9 ab\n c", "abcdefgh"]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, i int, t string")
    for inside in (False, True):
        got = {r["i"]: r["grams"] for r in df.select("i", retrieval.char_grams("t", low, high, inside).alias("grams")).collect()}
        assert {i: sorted(x) for i, x in got.items()} == {i: sorted(plain_grams(t, low, high, inside)) for i, t in enumerate(texts)}
    asks = spark.createDataFrame([("g", "catz")], "g string, q string")
    found = retrieval.search(df, "g", "i", F.col("t"), asks, F.col("q"), 2, 2, 3, analyzer="char_wb").orderBy("rank").collect()
    assert {r["i"] for r in found} == {0, 3}


def test_tfidf_index_partitions_follow_the_rows(spark):
    docs = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 11}", "x"]) for i in range(200)], "id long, t array<string>")
    asked = spark.createDataFrame([("w1",), ("x",)], "token string")
    whole = retrieval.tfidf_index(docs, "id", F.col("t"), asked=asked)[0]
    dealt = retrieval.tfidf_index(docs, "id", F.col("t"), asked=asked, task_rows=50)[0]
    assert dealt.rdd.getNumPartitions() >= 11  # some 570 terms
    rows = lambda df: sorted((r["token"], r["id"], round(r["weight"], 9)) for r in df.collect())
    assert rows(dealt) == rows(whole) and {r[0] for r in rows(whole)} == {"w1", "x"}
