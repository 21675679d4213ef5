import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions import numbers, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


FLOATS = {
    "1,000.7": 1000.7, "1,000": 1000.0, "5,5556": 5.5556, "0.0.0.1": 1.0, "0,0,0,1": 1.0, "12": 12.0, " 7 ": 7.0, "-3.5": -3.5, "1e3": 1000.0, "1_0": 10.0, ".5": 0.5, "1,234,5": 12345.0,
    "1d": None, "abc": None, "": None, "1__0": None, "inf": math.inf, "-inf": -math.inf, "5.": 5.0,
}


def test_float_ladder(spark):
    got = {r["x"]: r["y"] for r in spark.createDataFrame([(k,) for k in FLOATS] + [("nan",), (None,)], "x string").select("x", numbers.to_float("x").alias("y")).collect()}
    assert math.isnan(got.pop("nan")) and got.pop(None) is None
    assert got == FLOATS


def test_rounding_is_half_even_on_binary_values(spark):
    assert [one(spark, v, numbers.half_even, "double") for v in (0.125, 2.675, 12345.678)] == ["0.12", "2.67", "12345.68"]
    assert one(spark, 3.0, numbers.format_number, "double") == "3"


def test_tokens_and_normal_forms(spark):
    assert one(spark, "Été, 2.5%  a_b", text.tokenize) == ["été", ",", "2", ".", "5", "%", "a_b"]
    assert one(spark, "The  Cat's a_b, an ox!", text.answer_normalize) == "cats ab ox"
    assert one(spark, "The cat-an ox", text.phrase_normalize) == "cat ox"
    assert [one(spark, t, text.format_text) for t in ("N/A", "?", "", "a_B-c", "!!")] == ["EMPTY", "EMPTY", "EMPTY", "a b c", "EMPTY"]
    assert one(spark, 'Café "x" [1] (note)', text.wtq_normalize) == 'cafe "x"'
    assert one(spark, '"Quoted."', text.wtq_normalize) == "quoted"


def test_identifiers(spark):
    assert tuple(one(spark, "a-b-1_2", text.parse_question_id)) == ("a-b", "1", 2)
    assert one(spark, "nothing", text.parse_question_id) is None
    assert [one(spark, t, text.example_id) for t in ("1234-2_0", "abcd-123/10-1_0", "x")] == ["1234", "abcd-123", "x"]
    assert one(spark, "a_b_3", text.interaction_id) == "a_b"
    with pytest.raises(Exception, match="annotator"):
        spark.range(1).select(text.sequence_id(F.lit("a"), F.lit("b-c"))).collect()


@pytest.mark.parametrize("value", ["", "abc", "naïve 漢字", "x" * 1000])
def test_hashes_equal_python(spark, value):
    import hashlib

    n = int(hashlib.sha256(value.encode()).hexdigest(), 16)
    assert one(spark, value, text.sha_mod32) == n % (2**32 - 1)
    assert int(one(spark, value, text.sha_mod64)) == n % (2**64 - 1)
    assert one(spark, value, text.sha_bucket) == n % 2048


def test_text_ints_round_trip(spark):
    ints = one(spark, "héé", lambda c: text.text_to_ints(c, 8))
    assert ints == [ord("h") + 1, 234, 234, 0, 0, 0, 0, 0]
    assert one(spark, ints, text.ints_to_text, "array<int>") == "héé"
    with pytest.raises(Exception, match="too long"):
        one(spark, "abc", lambda c: text.text_to_ints(c, 2))


def values(t):
    return [(s["begin"], s["end"], [v["float_value"] if v["float_value"] is not None else tuple(v["date"].values()) for v in s["values"]]) for s in numbers.parse_spans(t)]


def test_number_and_date_spans():
    assert values("1,200 goals") == [(0, 5, [1200.0])]
    assert values("the third of twelve") == [(4, 9, [3.0]), (13, 19, [12.0])]
    assert values("fifth") == []  # the word list spells it otherwise
    assert values("24 april 1950")[0][2] == [(1950, 4, 24)]
    assert values("2010")[0][2] == [2010.0, (2010, None, None)]
    assert values("3000")[0][2] == [3000.0]
    assert values("-5 and x-5") == [(0, 2, [-5.0]), (9, 10, [5.0])]
    assert values("") == []


def test_spans_in_spark(spark):
    rows = spark.createDataFrame([("may 2001",), (None,)], "x string").select(numbers.number_spans("x").alias("s")).collect()
    assert rows[1]["s"] is None and rows[0]["s"][0]["values"][0]["date"]["month"] == 5


def test_partial_dates_compare_on_common_fields(spark):
    df = spark.createDataFrame([((2010, 5, 5), (2007, 8, None)), ((None, 3, None), (2000, None, None))], "a struct<year:int,month:int,day:int>, b struct<year:int,month:int,day:int>")
    x, y = numbers.date_key("a", "b")
    assert [(r["x"], r["y"]) for r in df.select(x.alias("x"), y.alias("y")).collect()] == [([2010, 5], [2007, 8]), (None, None)]


@pytest.mark.parametrize(
    "said, plain",
    [
        ("Café “x” [1] (note)", 'cafe "x"'), ("[12]", ""), ("[note]", "[note]"), ("a [b [c]", "a"), ("[a [b]", "[a"), ("a (b) (c)", "a"), ("(b)", "(b)"), ("x†‡ [2]*", "x"),
        ('"a "b" c"', '"a "b" c"'), ("a–b—c", "a-b-c"), ("U.S..", "u.s."), ("<b>x</b>  y\n z", "x y z"), ("", ""), ("x (a [1])", "x"), ('"q" (r)', "q"), ("ends )", "ends )"),
    ],
)
def test_full_normal_form(spark, said, plain):
    assert one(spark, said, text.wtq_normalize) == plain


def test_text_helpers(spark):
    df = spark.createDataFrame([("no", "no nose, no-go no"), ("", "a")], "n string, h string")
    assert [r[0] for r in df.select(text.find_all(F.col("n"), "h")).collect()] == [[0, 9, 15], []]
    assert one(spark, "the cat the catalog the cat", lambda c: text.replace_phrase(c, F.lit("the cat"), F.lit("a dog"))) == "a dog the catalog a dog"
    assert one(spark, "It isn't 3.5, (really) Bob's.", text.split_marks) == ["It", "is", "n't", "3.5", ",", "(", "really", ")", "Bob", "'s", "."]
    assert one(spark, "One. Two? Three", text.sentences) == ["One.", "Two?", "Three"]


def test_addresses_and_character_references(spark):
    from urllib.parse import unquote

    texts = ["a%20b", "a+b", "%E6%9D%B1", "100%", "%zz%41", "", "plain", "%2B%25"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(text.unquote("t")).collect()] == [*map(unquote, texts), None]
    bad = spark.createDataFrame([("%ff",)], "t string")
    assert bad.select(text.unquote("t")).first()[0] == "%ff"
    refs = spark.createDataFrame([("a &amp; b &lt;i&gt; &#233;&nbsp;&nope;",), (None,)], "t string")
    assert [r[0] for r in refs.select(text.unescape_html("t")).collect()] == ["a & b <i> \u00e9\u00a0&nope;", None]
    urls = ["https://x.org/wiki/New_York#top", "https://x.org/w/index.php?title=S%C3%A3o_Paulo&oldid=1", "https://x.org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in pages.orderBy("i").select(text.page_title("u")).collect()] == ["New York", "S\u00e3o Paulo", ""]


def test_dates_are_sought_only_where_digits_or_months_are(monkeypatch):
    asked = []
    read = numbers.read_date
    monkeypatch.setattr(numbers, "read_date", lambda x: asked.append(x) or read(x))
    words = " ".join(["word"] * 500)
    found = numbers.parse_spans(f"{words} May {words} 3 March 2001, twelve {words}")
    assert [[v["date"] for v in f["values"]][0] for f in found] == [{"year": None, "month": 5, "day": None}, {"year": 2001, "month": 3, "day": 3}, None]
    assert len(asked) < 40 and len(set(asked)) == len(asked)  # some 7,500 runs of tokens before
