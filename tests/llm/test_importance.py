"""op13 against plain Python; the distributed draw on ties, hot scores and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import importance
from tablewright.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def buckets_of(text, n=2, buckets=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def gumbel(doc_id):
    h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def brute(docs, bench, percent=25, n=2):
    feats = [buckets_of(t, n) for _, t in docs]
    s, t = Counter(b for f in feats for b in f), Counter(b for x in bench for b in buckets_of(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for (i, text), f in zip(docs, feats):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + gumbel(i), None, len(words(text))])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[5], r[1], r[2]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_equals_joined_ngrams(n):
    for text in ["", "a", "a b", "the cat sat on the mat the cat", "é 日本 " * 30, " x\u0000y,z "]:
        got = importance.checksums(importance.words_of(text.encode()), n)
        assert sorted(c % 10_000 for c in got) == sorted(buckets_of(text, n))


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, QUERIES["op13_resample"](spark, sf).collect()), key=repr) == brute(docs, bench)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " ,.! "), (4, "A a a"), (5, long), (6, "Größe ß 日本 " * 9), (None, "no id " * 12), (None, "no id " * 12), (7, "same text here " * 8), (7, "same text here " * 8), (8, "word " * 19), (9, "word " * 20)]
    bench = [None, "", "word word größe", "same text"]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in docs], "doc_id long, text string, score int, weight int, rank int, n int, bucket int")
    target = spark.createDataFrame([(x, 1) for x in bench], "text string, n int")
    for percent in (0, 25, 60, 100):
        out = importance.resample(df, target, percent=percent).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, out.collect()), key=repr) == brute(docs, bench, percent)
    assert importance.resample(df.limit(0), target).count() == 0
    few = importance.resample(df, target.limit(0)).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, few.collect()), key=repr) == brute(docs, [])


def test_draw_of_hot_scores(spark):
    """One score on a third of the rows, scores far apart, ids at both ends of their range and null ids."""
    rng = np.random.default_rng(5)
    rows = [(int(i), 7 if i % 3 == 0 else int(rng.integers(-70_000, 70_000)), bool(i % 5)) for i in range(6_000)]
    rows += [(None, 7, True)] * 3 + [(2**63 - 1, 7, True), (-(2**63), 7, True), (11, 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean")
    may = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    for percent in (1, 50, 99):
        got = importance.draw(df, percent).collect()
        assert len(got) == len(rows)
        drawn = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
        assert drawn == [(k, r[0], r[1]) for k, r in enumerate(may[: percent * len(may) // 100], 1)]


def test_draw_prefers_the_target(spark):
    rng = np.random.default_rng(1)
    own, other = [f"t{i}" for i in range(50)], [f"o{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choice(own if i % 4 == 0 else other, 40))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choice(own, 200)),) for _ in range(5)], "text string")
    ranked = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(ranked) == 100 and sum(r["doc_id"] % 4 == 0 for r in ranked) > 60
