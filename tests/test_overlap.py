"""Stems, overlap with questions, attention masks and WordPiece against brute force and known words."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import stems, wordpiece
from tablewright.operators import attention, overlap

KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radically": "radic", "differently": "differ", "vileness": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formality": "formal", "sensitiviti": "sensit",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "dying": "die", "skies": "sky", "died": "die", "flies": "fli", "spied": "spi", "enjoy": "enjoy", "by": "by", "a": "a", "": "",
}


@pytest.mark.parametrize("word", KNOWN)
def test_stem(word):
    assert stems.stem(word) == KNOWN[word]


def test_overlap(spark):
    cells = spark.createDataFrame([("t", 0, 0, "Running cats"), ("t", 1, 0, "dog"), ("t", 0, 1, None), ("t", 1, 1, "Prices"), ("u", 0, 0, "cat")], "table_id string, row_index int, column_index int, text string")
    asked = spark.createDataFrame([("q", "t", "the cat runs"), ("n", "t", None), ("x", "none", "cat")], "question_id string, table_id string, question string")
    got = {(r["question_id"], r["column_index"]): (round(r["score"], 6), r["rank"]) for r in overlap.score_columns(asked, cells).collect()}
    # {run, cat, dog} and {the, cat, run}; a null cell has no stems, a null question overlaps nothing
    assert got == {("q", 0): (0.5, 1), ("q", 1): (0.0, 2), ("n", 0): (0.0, 1), ("n", 1): (0.0, 2)}
    best = [r for r in overlap.score_cells(asked, cells).collect() if r["question_id"] == "q" and r["rank"] == 1]
    assert [(r["row_index"], r["column_index"]) for r in best] == [(0, 0)] and best[0]["score"] == pytest.approx(0.5 + 2 / 3 + 2 / 3)
    assert overlap.score_columns(asked.limit(0), cells).count() == 0


def _neighbours(buckets, n, size, i, j):
    gap = abs(buckets[i] - buckets[j])
    return gap <= 1 or gap == n // size - 2 or 0 in (buckets[i], buckets[j])


def test_masks(spark):
    turn = random.Random(3)
    rows = [(0, [], [], [], [])] + [(k, *[[turn.randrange(m) for _ in range(k)] for m in (2, 4, 4, 2)]) for k in range(1, 16)]
    df = spark.createDataFrame(rows, "k int, s array<int>, c array<int>, r array<int>, v array<int>")
    s, c, r, v = (F.col(x) for x in "scrv")
    df = df.withColumn("b", attention.bucket_ids(r, v, 3, 2))
    out = df.select("k", "b", attention.sparse_mask(s, c, r, v).alias("all"), attention.headwise_mask(s, r, v).alias("rows"), attention.headwise_mask(s, r, v, F.col("b"), 3).alias("near"))
    got = {x["k"]: x for x in out.collect()}
    for k, s, c, r, v in rows:
        order = sorted(range(k), key=lambda i: (1 - v[i], r[i], i))
        b = [max((order.index(i) - 2) // 3 + 1, 0) for i in range(k)]
        question = [[s[i] == 0 or s[j] == 0 for j in range(k)] for i in range(k)]
        assert got[k]["b"] == b
        assert got[k]["all"] == [[int(v[j] == 1 and (question[i][j] or c[i] == c[j] or r[i] == r[j])) for j in range(k)] for i in range(k)]
        rows_only = [[v[j] == 1 and (question[i][j] or r[i] == r[j]) for j in range(k)] for i in range(k)]
        assert got[k]["rows"] == [[int(x) for x in line] for line in rows_only]
        assert got[k]["near"] == [[int(rows_only[i][j] and _neighbours(b, k, 3, i, j)) for j in range(k)] for i in range(k)]


def _greedy(word, vocabulary):
    out, a = [], 0
    while a < len(word):
        for z in range(len(word), a, -1):
            piece = ("##" if a else "") + word[a:z]
            if piece in vocabulary:
                out.append(piece)
                a = z
                break
        else:
            return ["[UNK]"]
    return out


def test_wordpiece(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[unused0]\n[UNK]\na\nab\nabc\n##a\n##b\n##ca\n##cab\n,\n")
    vocabulary = wordpiece.read_vocabulary(spark, str(tmp_path / "vocab.txt"))
    assert vocabulary[0] == "[EMPTY]" and len(vocabulary) == 10
    turn = random.Random(5)
    words = ["".join(turn.choice("abc") for _ in range(turn.randrange(1, 9))) for _ in range(60)]
    rows = [(i, w) for i, w in enumerate(words)] + [(100, None), (101, ""), (102, "n/a"), (103, "Ábc, AB"), (104, "a" * 201), (105, "a" * 200)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("p", wordpiece.pieces("t", vocabulary))
    got = {r["i"]: (r["p"], r["w"]) for r in df.withColumn("w", wordpiece.whole_words(F.col("p"))).collect()}
    for i, w in enumerate(words):
        assert got[i][0] == _greedy(w, set(vocabulary))
        assert got[i][1] == ([w] if got[i][0] != ["[UNK]"] else ["[UNK]"])
    assert got[100][0] is None and got[101][0] == got[102][0] == ["[EMPTY]"]
    assert got[103][0] == ["abc", ",", "ab"] and got[104][0] == ["[UNK]"] and len(got[105][0]) == 200


def test_texts_are_cut_in_parts_of_bounded_size(spark, monkeypatch):
    """However long a batch is, a call to the tokenizer has some ``CHUNK_BYTES`` of text, or one text."""
    import pyarrow as pa

    texts = pa.array(["ab c", None, "", "x" * 30, "é" * 7, "a", "b"])
    monkeypatch.setattr(wordpiece, "CHUNK_BYTES", 10)
    parts = list(wordpiece._encoded(texts, ("a", "b", "c", "##b"), 200))
    assert [len(p) for p in parts] == [3, 1, 1, 2] and [None if e is None else e.tokens for e in parts[0]] == [["a", "##b", "c"], None, []]
    assert list(wordpiece._encoded(texts.slice(0, 0), ("a",), 200)) == []
    df = spark.createDataFrame([("ab c",), (None,), ("",), ("n/a",)], "t string")
    assert [r[0] for r in df.select(wordpiece.piece_counts("t", ["a", "c", "##b"])).collect()] == [3, None, 1, 1]


BACK = ["the", "new", "york", "yor", "##k", "caf", "##e", "3", "5", ".", "-", "ber", "##lin", "o", "##slo", "東", "京", "(", ")", "a", "##b", "##c", "s", "##tra", "##ss", "##e"]
TEXTS = ["The New-York CAFÉ", "3.5 (Berlin)", "東京 Oslo", "Café", "Straße  x", "Abc\u200babc", "", None, "ÉÉ unknown cafe", "a\tb\u00a0abc 3-5"]


def test_pieces_know_their_places(spark):
    """Accents, cases, CJK and control characters: a piece's characters, normalised, are the piece."""
    import unicodedata

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").withColumn("a", wordpiece.aligned_pieces("t", BACK)).withColumn("p", wordpiece.pieces("t", BACK))
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s).lower() if not unicodedata.combining(c))
    for r in df.collect():
        if r["t"] is None:
            assert r["a"] is None
            continue
        if r["t"]:
            assert [x["piece"] for x in r["a"]] == r["p"]
        ends = [0] + [x["end"] for x in r["a"]]
        assert all(x["begin"] >= before for x, before in zip(r["a"], ends))
        for x in r["a"]:
            if x["piece"] != wordpiece.UNKNOWN:
                assert plain(r["t"][x["begin"] : x["end"]]).replace("\u200b", "") == x["piece"].removeprefix("##")
    spans = [(0, 0, 0, "The"), (0, 1, 3, "New-York"), (0, 2, 2, "-"), (0, 4, 5, "CAFÉ"), (0, 5, 5, "CAFÉ"), (1, 0, 2, "3.5"), (1, 3, 3, "("), (1, 4, 4, "Berlin"), (2, 0, 0, "東"), (2, 0, 2, "東京 Oslo"), (0, 4, 99, None), (0, 2, 1, None), (6, 0, 0, None)]
    asked = spark.createDataFrame(spans, "i int, first int, last int, want string").join(df, "i")
    for r in asked.select("want", wordpiece.original_text("t", F.col("a"), F.col("first"), F.col("last")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_answers_get_the_texts_of_their_cells(spark):
    cells = spark.createDataFrame([("t", 0, 0, "The Café"), ("t", 0, 1, "CAFÉ"), ("t", 1, 0, "3.5 (Berlin)"), ("t", 1, 1, None), ("u", 0, 0, "Oslo")], "table_id string, row_index int, column_index int, text string")
    asks = [("a", "t", ["caf", "##e"]), ("b", "t", ["3", ".", "5"]), ("c", "t", ["o", "##slo"]), ("d", "t", ["lin"]), ("e", "t", []), ("f", "v", ["the", "new"])]
    df = spark.createDataFrame(asks, "question_id string, table_id string, pieces array<string>")
    got = {r["question_id"]: (r["text"], r["row_index"], r["column_index"]) for r in wordpiece.answer_texts(df, cells, BACK).collect()}
    assert got == {"a": ("Café", 0, 0), "b": ("3.5", 1, 0), "c": ("oslo", None, None), "d": ("lin", None, None), "e": ("", None, None), "f": ("the new", None, None)}
