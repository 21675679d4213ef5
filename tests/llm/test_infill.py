"""op11 against plain Python; arrangements read back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import infill
from tablewright.llm.queries import QUERIES

MARKS = ("<P>", "<S>", "<M>")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    t = text or ""
    digest = sha(f"1:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    spm = h4 % 100 < 20
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if spm else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return doc_id, n, "spm" if spm else "psm", a, b - a, sha(out), sha(t)


def digests(out):
    back = out.withColumn("r", infill.restore(F.col("output"), F.col("form")))
    return sorted(map(tuple, back.select("doc_id", "n", "form", "prefix_units", "middle_units", F.sha2(F.col("output").cast("binary"), 256), F.sha2(F.col("r").cast("binary"), 256)).collect()), key=repr)


ODD = ["", None, "a", "<", "<<", "<P", "S>", "<S", "a<P>b", "<M>", "é😀\r\n x\u0085y\u0000z", "<P<S<M" * 5, "ab<" * 40, "日本語" * 700, "x" * 60_000, " \n\t "]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 6)] + [(None, "no id"), (None, "no id"), (3, "twice"), (3, "twice"), (3, "other")]
    df = spark.createDataFrame([(i, t, 1, "x", 2, "u") for i, t in rows], "doc_id long, text string, n int, form string, _a int, _units string")
    assert digests(infill.transform(df)) == sorted((brute(*r) for r in rows), key=repr)
    assert infill.transform(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op11_infill"](spark, sf).collect()), key=repr)
    assert got == sorted((brute(*r) for r in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_all_forms_and_other_sentinels_and_units(spark):
    marks = infill.Sentinels("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    df = spark.createDataFrame([(i, f"def f{i}(x): return x < {i}  # <|fim <P>") for i in range(40)], "id long, body string")
    for spm in (0, 100):
        out = infill.transform(df, "id", "body", seed=9, keep_percent=0, spm_percent=spm, sentinels=marks, unit=r"\s*\S+\s*")
        back = out.withColumn("r", infill.restore(F.col("output"), F.col("form"), marks)).join(df, "id").collect()
        assert all(r["r"] == r["body"] and r["form"] == ("spm" if spm else "psm") for r in back)
        assert len({r["prefix_units"] for r in back}) > 3 and all(r["n"] == 9 for r in back)
    assert all(r["form"] == "plain" for r in infill.transform(df, "id", "body", keep_percent=100).collect())


@settings(max_examples=60)
@given(st.text(alphabet="<PSM>a", max_size=12), st.integers(0, 12), st.integers(0, 12), st.booleans())
def test_no_mark_arises_at_an_edge(t, x, y, spm):
    """The claim behind ``restore``: in a text without marks, the marks of an output are the only ones in it."""
    if any(m in t for m in MARKS):
        return
    a, b = sorted((min(x, len(t)), min(y, len(t))))
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if spm else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    assert sum(out.count(m) for m in MARKS) == 3


def test_broken_outputs_are_null(spark):
    rows = [("psm", "<P>a<S>b"), ("psm", "a<P>b<S>c<M>d"), ("spm", "<P>a<S>b<M>c"), ("psm", "<P>a<S>b<M>c<M>"), ("other", "x"), (None, "x"), ("plain", "a<P>"), ("spm", "<S>b<P>a<M>c")]
    df = spark.createDataFrame(rows, "form string, output string")
    assert [r[0] for r in df.select(infill.restore(F.col("output"), F.col("form"))).collect()] == [None] * 6 + ["a<P>", "acb"]


def test_sentinels_that_could_overlap_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<S<", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            infill.Sentinels(*bad)
