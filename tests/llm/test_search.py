"""op1, op2 and op6 against brute force."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import knn, urlrules, vectors
from tablewright.llm.oracles import ORACLES
from tablewright.llm.queries import QUERIES


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vec_table(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def brute_topk(data, k=10):
    good = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(object)) for i, v, _ in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in good}:
        if q % 100 == 0:
            best = sorted((-int(np.array(x, dtype=object) @ v), i) for i, v in good if i != q and len(v) == len(x))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def test_topk_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), 0) for i in range(60)]
    data += [data[0], data[0], data[5], data[5], data[7], (0, [1.0, 1.0, 2.0, 2.0], 0), (5, [2.0, 2.0, 2.0, 2.0], 0), (None, [9.0] * 4, 0)] + [(8, [2.0, 2.0, 2.0, 1.0], 0)] * 30
    cols = "vec_id long, embedding array<float>, label int, q int, dim int, shard int, ask int, floor int, copies int, home int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in data], cols)
    points = knn.quantised(df, "vec_id", "embedding")
    for size in (8, 8192):
        assert rows(knn.top_k(points.where("vec_id % 100 = 0"), points, shard_rows=size)) == brute_topk(data)


def test_topk_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), 0) for i in range(420)]
    data += [(500, None, 0), (501, [1.0, None], 0), (502, [float("nan")] * 6, 0), (503, [float("inf")] * 6, 0), (504, [], 0), (600, [1.0, 2.0], 0), (601, [1.0, 1.0], 1)]
    df = vec_table(spark, data)
    points = knn.quantised(df, "vec_id", "embedding")
    got = knn.top_k(points.where("vec_id % 100 = 0"), points, shard_rows=64)
    assert rows(got) == brute_topk(data)


def test_topk_of_huge_components_and_empty_table(spark):
    data = [(0, [1e13, 3.0], 0), (1, [2.0, 1e12], 0), (2, [1.0, 1.0], 0)]
    points = knn.quantised(vec_table(spark, data), "vec_id", "embedding")
    exact = {r["vec_id"]: r["score"] for r in knn.top_k(points.where("vec_id = 0"), points).collect()}
    a = [int(np.floor(1024 * float(np.float32(x)))) for x in data[0][1]]
    b = [int(np.floor(1024 * float(np.float32(x)))) for x in data[1][1]]
    assert exact[1] == min(2**63 - 1, a[0] * b[0] + a[1] * b[1])
    none = knn.quantised(vec_table(spark, []), "vec_id", "embedding")
    assert knn.top_k(none, none).count() == 0


def test_tree_prunes(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (500, 4)) for c in ([5, 0, 0, 0], [-5, 0, 0, 0])])
    tree = knn.KDTree(points)
    q, ids = np.array([1.0, 0, 0, 0]), np.arange(1000)
    best = tree.search(q, ids, -1, 10)
    assert [ids[i] for _, i in best] == np.lexsort((ids, -(points @ q)))[:10].tolist()
    assert tree.search(q, ids, -1, 10, floor=1e9) == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert rows(got) == sorted((tuple(r[names.index(c)] for c in got.columns) for r in found.fetchall()), key=repr)


URLS = [
    ("https://Example.NET/en/x", "example.net", "/en/x", "example.net/en/", "allow"),
    ("https://a.example.net/de/", "a.example.net", "/de/", "net/", "block"),
    ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://x.net?u=/y", "x.net", "", None, "allow"),
    ("http://x.com/y.net/en/", "x.com", "/y.net/en/", None, "allow"),
    ("http://b.example.com/de/1?q#f", "b.example.com", "/de/1", "example.com/de/", "block"),
    ("http://example.org/fr/é", "example.org", "/fr/é", "org/fr/", "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("no scheme", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
    ("http://x.net/" + "a" * 50_000, "x.net", "/" + "a" * 50_000, "net/", "block"),
]


def test_url_cases(spark):
    rules = [urlrules.Rule("net", "/", "block"), urlrules.Rule("example.net", "/en/", "allow"), urlrules.Rule("example.com", "/de/", "block"), urlrules.Rule("org", "/fr/", "allow")]
    data = [(i, u, "x") for i, (u, *_) in enumerate(URLS)] * 2
    df = spark.createDataFrame(data, "page_id long, url string, host string")
    got = sorted(map(tuple, urlrules.judge(df, rules).collect()))
    assert got == sorted([(i, *rest) for i, (_, *rest) in enumerate(URLS)] * 2)
    assert urlrules.judge(df.limit(0), rules).count() == 0


def test_globs_over_many_words():
    import fnmatch

    globs = [f"p{i}*x**" for i in range(40)]
    texts = [b"p3ax", b"p3a/x", b"p39zzx/q/x", b"", b"p7", b"p1x"]
    got = urlrules.ShiftAnd(globs).run(texts)
    for t, row in zip(texts, got):
        head = t.decode().split("/")[0]
        want = [fnmatch.fnmatchcase(head, g.replace("**", "*")) for g in globs]
        assert row.tolist() == want


def brute_links(data, threshold=0.9):
    good = {n: np.array(v, dtype=np.float64) for n, (i, v, _) in enumerate(data) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {n: data[n][0] for n in range(len(data))}
    near = {n: [] for n in good}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]):
                c = good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b]))
                if c >= threshold:
                    near[a].append(b)
    comp = dict(label)
    changed = True
    while changed:
        changed = False
        for a in near:
            low = min([comp[a], *[comp[b] for b in near[a]]])
            if low < comp[a]:
                comp[a], changed = low, True
    return sorted([(label[n], len(near.get(n, [])), comp[n], comp[n] == label[n] if label[n] is not None else True) for n in label], key=repr)


def test_vector_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    data = [(i, v.astype(np.float32).astype(float).tolist(), 0) for i, v in enumerate(base)]
    data += [(200 + i, (base[i % 20] + rng.normal(size=16) * 0.05).astype(np.float32).astype(float).tolist(), 0) for i in range(120)]
    data += [(400 + i, data[3][1], 1) for i in range(40)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [1.0, 2.0], 0), (504, [2.0, 4.0], 0), (505, [], 0), (506, [1.0, None], 0)]
    got = vectors.links(vec_table(spark, data), recall=0.999, chunk=32)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(data)
    assert vectors.links(vec_table(spark, [])).count() == 0


class Near:
    def __init__(self, unit, threshold):
        self.unit, self.threshold = unit, threshold

    def block(self, at):
        return self.unit[at] @ self.unit[at].T >= self.threshold

    def pairs(self, a, b):
        return vectors.cosines(self.unit, a, b, 7) >= self.threshold


@pytest.mark.parametrize("small", [2, 8, 32])
def test_pairs_of_a_bundle(monkeypatch, small):
    monkeypatch.setattr(vectors, "_SMALL", small)
    rng = np.random.default_rng(9)
    cells = [(1, 0, 0, 50), (2, 0, 0, 3), (3, 0, 0, 1), (4, 0, 0, 9), (5, 0, 1, 40), (5, 1, 1, 12), (6, 1, 2, 5)]
    rows_ = [(k, lo, hi, int(rng.choice([lo, hi]))) for k, lo, hi, n in cells for _ in range(n)]
    rows_ = [rows_[i] for i in rng.permutation(len(rows_))]
    table = pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("key", "lo", "hi", "part"), zip(*rows_))})
    unit = vectors.unit_rows(rng.normal(size=(len(rows_), 3)).tolist())
    keys = rng.integers(0, 6, (len(rows_), 4))
    for tree in (0, 2, 4):
        a, b = vectors._near_pairs(table, keys, tree, Near(unit, 0.5))
        got = sorted(tuple(sorted(x)) for x in zip(a.tolist(), b.tolist()))
        want = []
        for i in range(len(rows_)):
            for j in range(i + 1, len(rows_)):
                (k, lo, hi, p), other = rows_[i], rows_[j]
                if (k, lo, hi) == other[:3] and (lo == hi or p != other[3]) and not (keys[i, :tree] == keys[j, :tree]).any() and unit[i] @ unit[j] >= 0.5:
                    want.append((i, j))
        assert got == want and len(want) > 20


def test_vectors_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(2, 16)).tolist()
    near = [(np.array(v) + rng.normal(size=16) * 0.02).tolist() for v in (x, y)]
    data = [(1, x, 0), (1, y, 0), (2, near[0], 0), (3, near[1], 0)]
    cols = "vec_id long, embedding array<double>, label int, id long, least long, vec int, tree int, key int, dim int"
    table = lambda rows: spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], cols)
    got = sorted(map(tuple, vectors.links(table(data)).collect()), key=repr)
    assert got == brute_links(data) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    more = [*data, (1, x, 0), (5, x, 0), (None, x, 0), (None, None, 0), (1, None, 0)]
    assert sorted(map(tuple, vectors.links(table(more)).collect()), key=repr) == brute_links(more)


def test_only_pairs_within_the_bounds_are_recomputed(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.normal(size=16)
    data = [(i, (base + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(12)]
    everything = rows(vectors.links(vec_table(spark, data), recall=0.999))
    assert everything == brute_links(data) and everything[0][1] == 11
    monkeypatch.setattr(vectors.BinaryCodes, "error", lambda self, factor: factor * 0 - 2)  # bounds that reject all pairs
    bands = {16: vectors.plan_bands(12, 0.9, 0.97, 256)}
    coded = next(vectors._encode(256, bands, 3)([pa.RecordBatch.from_pydict({"id": list(range(12)), "vec": [d[1] for d in data]})]))
    fixed = {c: pa.array([v] * 12, t) for c, v, t in (("tree", 16 * vectors._TREES, pa.int32()), ("key", 0, pa.int64()), ("lo", 0, pa.int32()), ("hi", 0, pa.int32()), ("part", 0, pa.int32()), ("copies", 1, pa.int64()))}
    table = pa.table({**{c: coded.column(c) for c in ("id", "dim", "code", "factor", "small", "lost")}, **fixed, "vec": pa.array([d[1] for d in data])})
    assert vectors._recompute(256, bands, 0.9, 3)(table).num_rows == 0
    monkeypatch.undo()
    assert vectors._recompute(256, bands, 0.9, 3)(table).num_rows == 12


def test_codes_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.08
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    off = []
    for seed in range(6):
        coder = vectors.BinaryCodes(32, seed=seed)
        packed, factor = coder.encode(x)
        guess, error = coder.estimate(packed, factor, y)
        diff = np.diag(guess) - (x * y).sum(axis=1)
        assert (np.abs(diff) <= error[:, 0]).mean() > 0.98
        off.append(diff.mean())
    assert abs(np.mean(off)) < 0.01


@pytest.mark.parametrize("n", [10_000, 1_000_000, 16_000_000, 1_000_000_000])
def test_recall_at_the_threshold_of_large_tables(n):
    rng = np.random.default_rng(n)
    coder = vectors.BinaryCodes(64)
    bands = vectors.plan_bands(n, 0.9, 0.97, coder.size)
    assert len(bands[0]) == int(np.ceil(np.log2(n)))
    x, z = (vectors.unit_rows(rng.normal(size=(10_000, 64)).tolist()) for _ in range(2))
    z = vectors.unit_rows((z - (x * z).sum(axis=1, keepdims=True) * x).tolist())
    last = 0
    for cosine in (0.9, 0.91, 0.92):
        packed, other = coder.encode(x)[0], coder.encode(cosine * x + np.sqrt(1 - cosine**2) * z)[0]
        differ = np.unpackbits(packed ^ other, axis=1)
        met = np.zeros(len(x), dtype=bool)
        for s in bands:
            met |= ~differ[:, s].any(axis=1)
        assert met.mean() >= max(0.97, last)
        last = met.mean()


def test_bands_stay_within_their_numbering(monkeypatch):
    monkeypatch.setattr(vectors, "_TREES", 128)
    bands = vectors.plan_bands(1_000_000_000, 0.9, 0.97, 256)
    assert len(bands) < 128 and vectors.found_share(len(bands), len(bands[0]), 256, np.arccos(0.9) / np.pi) >= 0.97


def test_recall_on_the_fixture(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"], 0) for r in df.collect()]
    want = {r[0]: r[1] for r in brute_links(data)}
    got = {r["vec_id"]: r["n_links"] for r in vectors.links(df).collect()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.97 * sum(want.values())


def test_components_of_chains_and_stars(spark):
    from tablewright.llm._components import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1100)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
