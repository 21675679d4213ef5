"""Learnt sentence boundaries: ratios in plain Python, what is learnt from a made corpus, cuts of known texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import sentences


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences in which ``approx.`` and ``vol.`` abbreviate, names follow ``dr.``, and ``However`` begins many."""
    rng = random.Random(3)
    nouns = [f"{a}{b}" for a in ("stone", "river", "table", "paper", "garden", "window") for b in ("s", "like", "work")]
    out = []
    for i in range(1_500):
        body = " ".join(rng.choice(nouns) for _ in range(rng.randint(4, 9)))
        extra = rng.choice(["approx. nine", "in vol. 4 of", "by Dr. Weber", "by Dr. Weber", "the", "some", "no"])
        first = rng.choice(["However", "However", "The", rng.choice(nouns).capitalize()])
        out.append(f"{first} {body} {extra} {rng.choice(nouns)} {rng.choice(['however', 'the'])} {rng.choice(nouns)}.")
    texts = [" ".join(out[i : i + 10]) for i in range(0, len(out), 10)]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " . ... !")], "id int, text string")


def test_scores_equal_plain_ones(spark, corpus):
    texts, df = corpus
    with_p, without = Counter(), Counter()
    for t in texts:
        for w in t.split():
            core = re.sub(r"^[0-9][0-9.,]*?(\.?)$", r"##number##\1", re.sub(r"^[\W_]+|[^\w.]+$", "", w).lower())
            (with_p if core.endswith(".") else without)[core.rstrip(".")] += 1
    n, p = sum(with_p.values()) + sum(without.values()), sum(with_p.values())
    log = lambda k, m, x: (k * math.log(x) if k else 0) + ((m - k) * math.log(1 - x) if m - k else 0)
    want = {}
    for w, k in with_p.items():
        if re.search(r"[a-z]", w) and w != "##number##" or w == "##number##":
            m = k + without[w]
            letters = len(w) - w.count(".")
            want[w] = -2 * (log(k, m, p / n) - log(k, m, 0.99)) * math.exp(-letters) * (w.count(".") + 1) * letters ** -without[w]
    got = {r["type"]: r["score"] for r in sentences.abbreviation_scores(sentences.words(df, "text")).collect()}
    assert set(got) == set(want) and all(got[w] == pytest.approx(want[w], rel=1e-9, abs=1e-300) for w in want)


def test_different_words_score_as_all_words_do(spark, corpus):
    odd = spark.createDataFrame([(903, "e.g. E.g. (e.g.), x.y... 3.5. 3.5 -- ?! a.b.c, ;. A.B.c \u0130. caf\u00e9. 12,5.")], "id int, text string")
    df = corpus[1].unionByName(odd)
    every, different = sentences.words(df, "text"), sentences.different_words(df, "text")
    assert different.count() == every.select("word").distinct().count() and different.agg(F.sum("times")).first()[0] == every.count()
    got, want = (sorted(map(tuple, sentences.abbreviation_scores(x).collect())) for x in (different, every))
    assert got == want and len(got) > 5


def test_training_reads_the_texts_once(spark, corpus):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = corpus[1].select("id", seen.asNondeterministic()("text").alias("text"))
    assert sentences.train(docs) == sentences.train(corpus[1])
    assert read.value == corpus[1].count()


def test_what_is_learnt(spark, corpus):
    model = sentences.train(corpus[1])
    assert {"vol", "dr"} <= model.abbreviations and not {"stones", "however", "the"} & model.abbreviations
    assert "dr weber" in model.collocations and "however" in model.starters
    assert sentences.train(corpus[1].limit(0)) == sentences.Model()
    assert len(sentences.train(corpus[1], most=1).abbreviations) == 1 and "approx" in sentences.train(corpus[1], known=("approx",)).abbreviations


MODEL = sentences.Model(frozenset({"dr", "approx", "e.g", "u.s", "vol", "inc"}), frozenset({"dr weber"}), frozenset({"however"}), frozenset({"prices", "however"}), frozenset())


@pytest.mark.parametrize("text, want", [
    ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
    ("He met Dr. Weber today. She left.", ["He met Dr. Weber today.", "She left."]),
    ("It was approx. nine, e.g. ten. Then more.", ["It was approx. nine, e.g. ten.", "Then more."]),
    ("Made by Acme Inc. However it failed.", ["Made by Acme Inc.", "However it failed."]),
    ("In the U.S. Prices rose.", ["In the U.S.", "Prices rose."]),
    ("J. R. Miller wrote it. (He did.) \"Yes.\" Ok", ["J. R. Miller wrote it.", "(He did.)", "\"Yes.\"", "Ok"]),
    ("It cost 3.50 in 1999. The rest is 5. of them", ["It cost 3.50 in 1999.", "The rest is 5. of them"]),
    ("Wait... what? Well... Then", ["Wait... what?", "Well...", "Then"]),
    ("line one\nline two. x\n\n  ", ["line one", "line two.", "x"]), ("", []), (None, []), ("  \n ", []),
])
def test_cuts(text, want):
    assert sentences.cut(text, MODEL) == want


def test_statements_are_filtered_by_length_and_title(spark):
    text = "Too short. This one has enough words. " + "word " * 40 + ". By Dr. Weber, as it was said."
    df = spark.createDataFrame([(1, text, "T"), (2, text, None), (3, None, "T"), (4, text, " ")], "id int, text string, title string")
    got = sentences.statements(df, "id", "text", MODEL, title="title").orderBy("place").collect()
    assert [(r["id"], r["sentence"]) for r in got] == [(1, "This one has enough words."), (1, "By Dr. Weber, as it was said.")]
    assert sentences.statements(df, "id", "text", MODEL).select("id").distinct().count() == 3


def test_sets_beyond_the_bound_are_met_whole(spark, corpus, monkeypatch):
    """Each document is cut by all entries that it asks about, where the sets are too large for one model."""
    odd = [(1000, "Dr. Weber vol. 4. However (approx.) nine. J. However 5. Stones.\nvol."), (1000, "In vol. Stones. by Dr. However."), (None, "By Dr. Weber. However it is.")]
    docs = corpus[1].unionByName(spark.createDataFrame(odd, "id int, text string"))
    learnt = sentences.learn(docs)
    whole = learnt.model()
    assert whole == sentences.train(docs) and len(whole.abbreviations) > 1 and learnt.model(1) is None
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(sentences.statements(docs, "id", "text", whole, 1, 99))
    monkeypatch.setattr(sentences, "MOST", 1)
    assert rows(sentences.statements(docs, "id", "text", learnt, 1, 99)) == want
    assert rows(sentences.statements(docs, "id", "text", sentences.learn(docs), 1, 99)) == want != rows(sentences.statements(docs, "id", "text", sentences.train(docs, most=1), 1, 99))


def test_cut_covers_every_word(spark, sf):
    """Nothing is lost: the sentences' words are the text's words, in order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    model = sentences.train(docs)
    for text, cut in docs.select("text", sentences.sentences("text", model).alias("s")).collect():
        assert " ".join(cut).split() == text.split()
    assert docs.select(F.explode(sentences.sentences("text", model)).alias("s")).where("trim(s) = ''").count() == 0
