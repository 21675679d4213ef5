"""Preparation, negatives, prediction metrics, token layouts and matching on small tables."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablewright.operators import evaluate, joins, layout, match, negatives, prepare, retrieval
from tablewright.schema import INTERACTION, from_cells

AT = "array<struct<row:int,col:int>>"


def interactions(spark):
    cells = [("t", r, c, f"h{c}", f"x{r}{c}") for r in range(3) for c in range(2)]
    return prepare.as_interactions(from_cells(spark.createDataFrame(cells, "table_id string, row_index int, column_index int, column_name string, text string")))


def test_tables_become_interactions(spark):
    one = interactions(spark)
    row = one.first()
    assert row["id"] == "t" and row["questions"] == [] and len(row["table"]["rows"]) == 3 and one.schema["questions"].dataType == INTERACTION["questions"].dataType
    assert prepare.inputs(one, "INTERACTION") is one
    with pytest.raises(ValueError):
        prepare.inputs(one, "LIST")
    assert (prepare.large_enough(one, 3, 2).count(), prepare.large_enough(one, 4, 2).count(), prepare.large_enough(one, 3, 3).count()) == (1, 0, 0)
    bare = prepare.without_table(one).first()["table"]
    assert bare["table_id"] == "t" and bare["columns"] == bare["rows"] == [] and bare["document_title"] is None
    many = one.select(F.explode(F.sequence(F.lit(1), F.lit(60))).alias("n"), "table", "questions").select(F.col("n").cast("string").alias("id"), F.col("table").withField("table_id", F.col("n").cast("string")).alias("table"), "questions")
    mixed = prepare.with_random_table(many, bins=2).collect()
    other = [r for r in mixed if r["other"] is not None]
    assert len(mixed) == 60 and 15 < len(other) < 45 and all(r["other"]["table_id"] != r["table"]["table_id"] for r in other)


def test_valid_answers(spark):
    df = spark.createDataFrame([("a", ["x"]), (" - ", ["[EMPTY]"]), ("", []), (None, None)], "t string, p array<string>")
    assert [tuple(r) for r in df.select(prepare.answer_text_is_valid(F.col("t")), prepare.pieces_are_valid(F.col("p"))).collect()] == [(True, True), (False, False), (False, False), (False, False)]
    groups = [("q", 0, ["a", "b"], [True, False]), ("q", 1, ["c"], [True]), ("q", 2, ["d"], [True]), ("r", 0, [], []), ("s", 0, ["e"], [None])]
    got = prepare.choose_answers(spark.createDataFrame(groups, "question_id string, group_index int, answers array<string>, located array<boolean>")).collect()
    assert [tuple(r) for r in got] == [("q", ["c"], [["d"]])]


def test_supervision_modes(spark):
    df = spark.createDataFrame([(["1,000"], [(0, 1)], "SUM", 3.0), (["7"], [], "NONE", None), (["a", "b"], [], None, None)], f"answer_texts array<string>, coordinates {AT}, aggregation string, float_answer float")
    show = lambda mode: [(len(r["coordinates"]), r["aggregation"], r["float_answer"]) for r in prepare.supervise(df, mode).collect()]
    assert show("NONE") == [(1, "SUM", 3.0), (0, "NONE", None), (0, None, None)]
    assert show("REMOVE_ALL") == [(0, None, 1000.0), (0, None, 7.0), (0, None, None)]
    assert show("REMOVE_ALL_STRICT") == [(0, None, None), (0, None, 7.0), (0, None, None)]
    with pytest.raises(ValueError):
        prepare.supervise(df, "SOME")


def test_masked_words_and_snippets(spark):
    pieces = [p for i in range(60) for p in ([f"w{i}"] if i % 3 else [f"w{i}", "##a", "##b"])]
    df = spark.range(40).withColumn("p", F.array(*map(F.lit, pieces)))
    kinds = {"mask": 0, "same": 0, "other": 0}
    for r in df.select(prepare.masked_words(F.col("p"), F.col("id"), ["x", "##y", "z"]).alias("m")).collect():
        at = [x["index"] for x in r["m"]]
        assert at == sorted(set(at)) and 1 <= len(at) <= round(0.15 * len(pieces)) <= 20 and all(x["label"] == pieces[x["index"]] for x in r["m"])
        for i in at:  # whole words
            start = max(k for k in range(i + 1) if not pieces[k].startswith("##"))
            assert start in at
        for x in r["m"]:
            kinds["mask" if x["shown"] == "[MASK]" else "same" if x["shown"] == x["label"] else "other"] += 1
            assert x["shown"] in ("[MASK]", x["label"], "x", "##y", "z")
    assert kinds["mask"] > 5 * kinds["same"] > 0 and kinds["other"] > 0
    cut = df.select(prepare.snippet(F.col("p"), F.col("id"), 5, 9).alias("s")).collect()
    assert {len(r["s"]) for r in cut} == {5, 6, 7, 8, 9} and all(" ".join(r["s"]) in " ".join(pieces) for r in cut)
    sizes = df.select(prepare.table_size(F.lit(30), F.lit(8), F.col("id"), 40).alias("t")).collect()
    assert all(1 <= r["t"]["columns"] <= 8 and 1 <= r["t"]["rows"] <= 30 and r["t"]["rows"] * r["t"]["columns"] <= 40 for r in sizes) and len({tuple(r["t"]) for r in sizes}) > 10


def test_predictions_and_structure(spark):
    gold = [("d-0", "NONE", [(0, 0)]), ("d-1", "SUM", [(1, 0), (2, 0)]), ("d-2", "COUNT", [(0, 1)]), ("d-3", "NONE", []), ("d-4", "SUM", [(3, 3)])]
    said = [("d-0", "NONE", [(0, 0)]), ("d-1", "SUM", [(2, 0), (1, 0)]), ("d-2", "SUM", [(0, 2)]), ("d-4", "AVERAGE", [(3, 4)])]
    schema = f"question_id string, aggregation string, coordinates {AT}"
    joined = evaluate.join_predictions(spark.createDataFrame(gold, schema), spark.createDataFrame(said, schema))
    assert {r["question_id"]: (r["pred_aggregation"], len(r["pred_coordinates"])) for r in joined.collect()}["d-3"] == ("NONE", 0)
    assert tuple(evaluate.structure(joined).first()) == (0.6, 0.6, 0.6, 5)
    with pytest.raises(PySparkException):
        evaluate.join_predictions(spark.createDataFrame(gold, schema), spark.createDataFrame([("x", "SUM", [])], schema)).collect()
    pairs = [(["992.39"], ["992.3900146484375"], True), (["nan"], [], True), (["B", "a"], ["A", "b"], True), (["1"], ["1", "1"], False), (["1,000"], ["1000"], True), (["x"], [], False)]
    df = spark.createDataFrame([(g, p) for g, p, _ in pairs], "g array<string>, p array<string>")
    assert [r[0] for r in df.select(evaluate.same_denotation(F.col("g"), F.col("p"))).collect()] == [x for _, _, x in pairs]


def test_negatives_of_questions(spark):
    asks = spark.createDataFrame([("q", "g", ["ann", "bo"]), ("r", "g", ["z"]), ("s", None, [])], "question_id string, gold_id string, answers array<string>")
    hits = [("q", "a", 1, 0.9, "ann met bo"), ("q", "b", 2, 0.8, "ann"), ("q", "b", 4, 0.1, "ann"), ("q", "g", 0, 1.0, "x"), ("q", "c", 3, 0.7, None), ("r", "g", 0, 1.0, ""), ("t", "a", 0, 1.0, ""), ("s", "a", 0, 0.5, "y")]
    got = negatives.hard_negatives(asks, spark.createDataFrame(hits, "question_id string, table_id string, rank int, score double, table_text string"), 2)
    cells = [("q", "split", 1, 0.9, ["New", "York"]), ("q", "whole", 2, 0.8, ["x", "in New York"]), ("q", "none", 3, 0.7, None)]
    near = negatives.hard_negatives(spark.createDataFrame([("q", "g", ["New York"])], "question_id string, gold_id string, answers array<string>"), spark.createDataFrame(cells, "question_id string, table_id string, rank int, score double, cells array<string>"), 5)
    assert [r["table_id"] for r in near.orderBy("place").collect()] == ["split", "none"]  # an answer over two cells is in none
    assert sorted(map(tuple, got.collect())) == [("q", 0, "b", -0.8), ("q", 1, "c", -0.7), ("r", 0, "FAKE", 0.0), ("s", 0, "a", -0.5)]
    tables = spark.createDataFrame([("a", "A"), ("a", "B")], "table_id string, title string")
    one = spark.createDataFrame([("q", "a")], "question_id string, table_id string")
    assert tuple(negatives.with_tables(one, tables).first()) == ("q", "a", "A")
    for bad in (lambda: negatives.with_tables(one.withColumn("table_id", F.lit("zz")), tables), lambda: negatives.gold_places(spark.createDataFrame([("q", ["zz"])], "query_id string, table_ids array<string>"), tables, 2)):
        with pytest.raises(PySparkException):
            bad().collect()


def test_as_of_keeps_left_rows(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("m", 9, "c"), (None, 9, "d")], "k string, t int, x string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 5, 51), ("k", 7, 70)], "k string, t int, v int")
    got = {r["x"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"a": 51, "b": None, "c": None, "d": None}
    assert {r["x"]: r["v"] for r in joins.as_of(left, right.where("t < 5"), ["k"], "t", ["v"], F.lit(2)).collect()}["a"] is None


def test_layouts_of_tokens(spark):
    scores = spark.createDataFrame([("q", 0, 0.2), ("q", 1, 0.9), ("q", 2, 0.5)], "q string, c int, s double")
    order = [r["c"] for r in layout.boost_previous(scores, scores.where("c = 0"), ["q"], "c", "s").orderBy("priority").collect()]
    assert order == [0, 1, 2]
    assert sorted(r["id"] for r in layout.padded(spark.createDataFrame([("a",), ("b",)], "id string"), "id", 4).collect()) == ["EMPTY-0_0", "EMPTY-0_0", "a", "b"]
    assert layout.padded(spark.createDataFrame([("a",), ("b",)], "id string"), "id", 2).count() == 2
    tokens = spark.createDataFrame([("q", 0, 1, 1, None)], "question_id string, pos int, column_id int, row_id int, value double")
    assert math.isnan(layout.numeric_scale(tokens).first()["numeric_value"])
    with pytest.raises(PySparkException):
        layout.answer_labels(tokens, tokens.withColumn("row_id", F.lit(9))).collect()


def test_assignment_and_cells(spark):
    options = [("q", "a", 0, 0), ("q", "a", 0, 1), ("q", "b", 0, 0), ("q", "c", 0, 1), ("r", "a", 1, 1)]
    got = match.assign(spark.createDataFrame(options, "question_id string, answer string, row_index int, column_index int")).collect()
    assert len(got) == 3 and len({(r["question_id"], r["row_index"], r["column_index"]) for r in got}) == 3 and {r["answer"] for r in got if r["question_id"] == "q"} <= {"a", "b", "c"}
    cells = spark.createDataFrame([("t", 0, 0, "New York City", []), ("t", 0, 1, "Newark", ["born in York, long ago", "York"]), ("t", 1, 0, None, None)], "table_id string, row_index int, column_index int, text string, descriptions array<string>")
    find = lambda a: {(r["row_index"], r["column_index"], r["via"]) for r in match.cells_naming(spark.createDataFrame([("q", "t", a)], "question_id string, table_id string, answer string"), cells).collect()}
    assert find("york") == {(0, 0, "text")} and find("in York") == {(0, 1, "description")} and find("ork") == find("") == set()
    maps = spark.createDataFrame([("a", {"a": "x", "b": "y"}, ["b"])], "k string, m map<string,string>, keys array<string>")
    assert match.referred(maps, F.col("m"), F.col("keys")).first()["descriptions"] == {"b": "y"}
    assert maps.select(match.described(F.col("k"), F.col("m"))).first()[0] == "x"
    with pytest.raises(PySparkException):
        maps.select(match.described(F.lit("zz"), F.col("m"))).collect()
    said = spark.createDataFrame([('[{"begin": 5, "text": "b"}, {"begin": 1, "text": "a"}, {"begin": 2, "text": " "}]',), ("[]",), (None,)], "p string")
    assert [r[0] for r in said.select(match.answer_text(F.col("p"))).collect()] == ["a b", None, None]


def test_descriptions_nearest_the_question(spark):
    cells = spark.createDataFrame([("q", 0, 0, "Ann", ["e1", "e2"]), ("q", 0, 1, "x", [])], "question_id string, row_index int, column_index int, text string, entities array<string>")
    asks = spark.createDataFrame([("q", "where was Ann born?")], "question_id string, question string")
    about = spark.createDataFrame([("q", "e1", "Ann Lee", "Ann sings. She was born in Rome. Cats sleep."), ("q", "e2", None, "Nothing here.")], "question_id string, identifier string, title string, text string")
    got = {r["column_index"]: r["text"] for r in retrieval.describe_cells(cells, asks, about, n=1).collect()}
    assert got == {0: "Ann ( Ann Lee : She was born in Rome. )", 1: "x"}


def test_hard_negatives_partitions_follow_the_hits(spark):
    hits = spark.createDataFrame([(f"q{i % 40}", f"t{i % 9}", i, float(i), f"x {i}") for i in range(400)], "question_id string, table_id string, rank int, score double, table_text string")
    asks = spark.createDataFrame([(f"q{i}", "t1", ["x"]) for i in range(41)], "question_id string, gold_id string, answers array<string>")
    open_asks = asks.withColumn("answers", F.array(F.lit("nowhere")))
    dealt = negatives.hard_negatives(open_asks, hits, 2, task_rows=20)
    shuffles = [x for x in dealt._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(question_id" in x]
    assert shuffles and all(", 20), REPARTITION_BY_NUM" in x for x in shuffles), shuffles  # no shuffle of another number
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, negatives.hard_negatives(open_asks, hits, 2).collect()))
    assert {r["table_id"] for r in negatives.hard_negatives(asks, hits, 2, task_rows=20).collect()} == {"FAKE"}
