import json

from pyspark.sql import functions as F

from tablewright.sources import readers, sinks
from tablewright.streaming import files


def test_question_tsv_groups_and_last_row_wins(spark, tmp_path):
    lines = ["id\tannotator\tposition\tquestion\ttable_file\tanswer_coordinates\tanswer_text\taggregation", "x\t0\t1\tsecond?\tt.csv\t['(1, 2)', '(0, 0)']\t['a', u\"b\"]\tsum", "x\t0\t0\tfirst?\tt.csv\t[]\t[]\t", "x\t0\t1\tagain?\tt.csv\t['(3, 4)']\t['c']\tCount"]
    p = tmp_path / "q.tsv"
    p.write_text("\n".join(lines))
    row = readers.question_tsv(spark, str(p)).first()
    assert row["id"] == "x-0" and [q["text"] for q in row["questions"]] == ["first?", "again?"]
    assert [tuple(c) for c in row["questions"][1]["coordinates"]] == [(3, 4)] and row["questions"][1]["aggregation"] == "COUNT"
    assert row["questions"][1]["question_id"] == "x-0_1" and row["questions"][0]["aggregation"] is None


def test_texts_of_a_list_literal(spark):
    got = spark.createDataFrame([("""['a, b', u"it's", 'x\\'y']""",)], "x string").select(readers.parse_texts(F.col("x"))).first()[0]
    assert got == ["a, b", "it's", "x'y"]


def test_csv_and_json_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('h1,h2\n"a ""q""",1\nb,2\n')
    cells = readers.csv_tables(spark, str(tmp_path / "t.csv"), escape="").orderBy("row_index", "column_index").collect()
    assert [(c["column_name"], c["text"]) for c in cells] == [("h1", 'a "q"'), ("h2", "1"), ("h1", "b"), ("h2", "2")]
    (tmp_path / "w.jsonl").write_text(json.dumps({"id": "t", "header": ["A", "N"], "types": ["text", "real"], "rows": [["x", "1,000"]]}))
    got = readers.table_jsonl(spark, str(tmp_path / "w.jsonl")).orderBy("column_index").collect()
    assert [(r["text"], r["number"]) for r in got] == [("x", None), ("1,000", 1000.0)]


def test_xml_spans_are_expanded(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<doc><table id="T"><row><cell col-start="0" col-end="1" row-start="0" row-end="0" text="h"/></row></table></doc>')
    got = sorted((r["row_index"], r["column_index"], r["text"]) for r in readers.xml_tables(spark, str(tmp_path / "t.xml")).collect())
    assert got == [(0, 0, "h"), (0, 1, "")]


def test_html_tables(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1 <span style='display: none'>no<b>ne</b></span></td><td>&amp;2</td></tr></table><table><tr><td>x</td></tr><tr><td>y</td><td>z</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "id int, html string")
    got = [(r["row_index"], r["column_index"], r["text"]) for r in readers.html_tables(pages, "id", "html").collect()]
    assert got == [(0, 0, "A"), (0, 1, "B"), (1, 0, "1"), (1, 1, "&2")]


def test_byte_places_of_long_pages(spark):
    """A page of many cells beside wide characters: places come from one reading, rows in parts."""
    text = "aé東𝄞" * 50 + "z"
    place = readers._byte_places(text)
    assert [place(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)] and readers._byte_places("ab")(2) == 2
    html = "<p>é</p><table>" + "".join(f"<tr><td>é{i}</td><td>x</td></tr>" for i in range(15_000)) + "</table>"
    got = readers.html_tables(spark.createDataFrame([(1, html), (2, "<table><tr><td>y</td></tr></table>")], "id int, html string"), "id", "html").collect()
    assert len(got) == 30_001 and all(html.encode()[r["begin"] : r["end"]].decode() == r["text"] for r in got[::997] if r["id"] == 1)


def test_hits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q", "b", 1, 1.0), ("q", "a", 0, 2.0)], "query_id string, table_id string, rank int, score double")
    sinks.hits(df, str(tmp_path / "hits"))
    back = readers.hits_jsonl(spark, str(tmp_path / "hits")).orderBy("rank").collect()
    assert [(r["table_id"], r["score"]) for r in back] == [("a", -2.0), ("b", -1.0)]


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q-0_0", [(2, 0), (1, 0), (0, 1)], "[1.5 2]"), ("EMPTY-0_0", [], "0")], "question_id string, answer_coordinates array<struct<row:int,col:int>>, logits_cls string")
    sinks.predictions(df, str(tmp_path / "p"))
    rows = readers.predictions_tsv(spark, str(tmp_path / "p")).collect()
    assert len(rows) == 1 and [tuple(c) for c in rows[0]["answer_coordinates"]] == [(1, 0), (2, 0), (0, 1)] and rows[0]["logits_cls"] == [1.5, 2.0]


def test_splits_and_routes(spark, tmp_path):
    df = spark.createDataFrame([(str(i),) for i in range(300)], "id string")
    sinks.partitioned_split(df, "id", str(tmp_path / "s"), 10)
    counts = {r["split"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().collect()}
    assert sum(counts.values()) == 300 and 10 < counts["test"] < 60
    routed = sinks.route(spark.createDataFrame([("train_1", "t"), ("dev_1", "t")], "id string, title string"), "id", "title").collect()
    assert routed[0]["split"] in ("train", "dev") and routed[1]["split"] == "test"


def test_new_files_are_processed_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    each = lambda df, i: seen.extend(r["x"] for r in df.collect())
    run = lambda: files.new_files(spark, str(folder), "x int", each, str(tmp_path / "cp"))
    (folder / "1.json").write_text('{"x": 1}')
    assert run() == 1 and run() == 0
    (folder / "2.json").write_text('{"x": 2}\n{"x": 3}')
    assert run() == 2 and seen == [1, 2, 3]


def test_sequences_feed_answers_forward(spark, tmp_path):
    turns = spark.createDataFrame([("s", 0), ("s", 1), ("r", 0)], "sequence_id string, position int")
    predict = lambda df: df.withColumn("answer", F.concat(F.coalesce("previous_answer", F.lit("")), F.lit("x")))
    got = {(r["sequence_id"], r["position"]): r["answer"] for r in files.previous_answers(turns, predict, 2, str(tmp_path / "answers")).collect()}
    assert got == {("s", 0): "x", ("s", 1): "xx", ("r", 0): "x"}


def test_html_layouts_and_byte_places(spark):
    info = "<p>é</p><table><tr><th>Näme</th><td>Bo</td></tr><tr><th>Age</th><td>7</td></tr></table>"
    wide = "<table>\n<tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c<table><tr><td>in</td></tr></table></td><td style='display: none'>x</td><td>d</td></tr></table>"
    odd = "<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"
    pages = spark.createDataFrame([(1, info), (2, wide), (3, odd), (4, None)], "p int, html string")
    rows = readers.html_tables(pages, "p", "html").collect()
    got = {(r["p"], r["table_index"], r["layout"], r["row_index"], r["column_index"]): r["text"] for r in rows}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0, "infobox", 0, 0): "Näme", (1, 0, "infobox", 0, 1): "Age", (1, 0, "infobox", 1, 0): "Bo", (1, 0, "infobox", 1, 1): "7"}
    assert [got[2, 1, "horizontal", r, c] for r in (0, 1) for c in (0, 1)] == ["a", "b", "c", "d"] and got[2, 0, "horizontal", 0, 0] == "in"
    assert not [k for k in got if k[0] in (3, 4)]
    for r in rows:
        if r["p"] == 1:
            assert info.encode()[r["begin"] : r["end"]].decode() == r["text"]


MESSAGE = """id: "t-0" table { columns { text: "A \\"q\\"" } columns { text: 'B' } rows { cells { text: "x" numeric_value { float_value: -1.5 } } cells: { text: "caf\\303\\251" } } } questions { id: "q" answer { aggregation: SUM is_valid: true class_index: 3 } } # end"""


def test_text_messages_round_trip(spark, tmp_path):
    from tablewright.schema import INTERACTION

    (tmp_path / "in.txtpb").write_text(MESSAGE.replace("# end", "") + "\n\nid: {\n")
    rows = readers.text_messages(spark, str(tmp_path / "in.txtpb"), INTERACTION)
    good = rows.where("error is null").drop("error").first()
    assert good["id"] == "t-0" and [c["text"] for c in good["table"]["columns"]] == ['A "q"', "B"]
    assert [c["text"] for c in good["table"]["rows"][0]["cells"]] == ["x", "café"] and good["table"]["rows"][0]["cells"][0]["numeric_value"]["float_value"] == -1.5
    assert (good["questions"][0]["answer"]["aggregation"], good["questions"][0]["answer"]["is_valid"], good["questions"][0]["answer"]["class_index"]) == ("SUM", True, 3)
    assert rows.where("error is not null").count() == 1
    sinks.messages(rows.where("error is null").drop("error"), str(tmp_path / "out"))
    again = readers.text_messages(spark, str(tmp_path / "out"), INTERACTION).drop("error").first()
    assert again["table"] == good["table"] and again["id"] == good["id"] and again["questions"][0]["answer"]["class_index"] == 3
    assert readers.parse_message("a: [1, 0x10] b: 2f c < d: E > # note\n a: 3") == {"a": [1, 16, 3], "b": [2.0], "c": [{"d": ["E"]}]}


def test_other_readers(spark, tmp_path):
    (tmp_path / "dir").mkdir()
    for name in ("a", "b.c"):
        (tmp_path / "dir" / f"{name}.json").write_text(json.dumps({"x": name}, indent=1))
    assert {(r["key"], r["x"]) for r in readers.json_directory(spark, str(tmp_path / "dir"), "x string").collect()} == {("a", "a"), ("b.c", "b.c")}
    (tmp_path / "e.tsv").write_text("query_id\tquery_rep\nq\t[0.5, -1e-3,\t2]\n".replace(",\t2", ", 2"))
    assert readers.embedding_tsv(spark, str(tmp_path / "e.tsv"), "query_id", "query_rep").first()["vector"] == [0.5, -0.001, 2.0]
    (tmp_path / "r.json").write_text(json.dumps({"table": ["a", "a"], "passage": ["b"]}))
    assert {tuple(r) for r in readers.reference_lists(spark, str(tmp_path / "r.json")).collect()} == {("a", "table"), ("b", "passage")}
    for split in ("train", "dev"):
        (tmp_path / f"{split}.jsonl").write_text('{"x": 1}\n')
    files_ = {s: [str(tmp_path / f"{s}.jsonl")] for s in ("train", "dev")}
    assert {(r["x"], r["split"]) for r in readers.split_files(spark, files_, "x int", 2).collect()} == {(1, "train"), (1, "dev")}
    assert readers.from_arrays(spark, [{"a": [1, 2]}], "a array<int>").first()["a"] == [1, 2]


def test_paths_and_exports(spark, tmp_path):
    import pytest

    from tablewright.sources import paths

    assert paths.pairs(["x/b.txtpb.gz", "a.json"], "out") == [("a.json", "out/a"), ("x/b.txtpb.gz", "out/b")]
    for bad in (["a.doc"], ["a.json", "b/a.txtpb"]):
        with pytest.raises(ValueError):
            paths.pairs(bad, "out")
    cells = spark.createDataFrame([("t", 0, 0, "H", 'a"b'), ("t", 0, 1, "I", None), ("t", 1, 0, "H", "c"), ("t", 1, 1, "I", "d")], "table_id string, row_index int, column_index int, column_name string, text string")
    sinks.tables_csv(cells, str(tmp_path / "csv"))
    lines = [x for f in (tmp_path / "csv" / "table_id=t").glob("*.txt") for x in f.read_text().splitlines()]
    assert lines == ['"H","I"', '"a\\"b",""', '"c","d"']
    said = spark.createDataFrame([("s1", "x"), ("s2", "y")], "statement_id string, text string")
    sinks.statements_xml(said, spark.createDataFrame([("s1", "entailed")], "statement_id string, label string"), str(tmp_path / "xml"))
    back = spark.read.format("xml").option("rowTag", "statement").schema("_id string, _type string, _text string").load(str(tmp_path / "xml"))
    assert {tuple(r) for r in back.collect()} == {("s1", "entailed", "x"), ("s2", "unknown", "y")}
