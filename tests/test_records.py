import gzip

import pytest
from pyspark.sql import types as T

from tablewright.sources import records, sinks

KIND = records.message(s=(1, "string"), i=(2, "int"), l=(3, "long"), f=(4, "float"), d=(5, "double"), b=(6, "boolean"), e=(7, ["A", "B"]), raw=(8, "binary"), many=(9, ("long",)), inner=(10, records.message(x=(1, "int"), ys=(2, ("string",)))), list=(16, (records.message(x=(1, "int")),)))
PLAIN = T.StructType([T.StructField(f.name, f.dataType) for f in KIND.fields])


def test_known_checksums_and_bytes():
    def unmasked(m):
        m = (m - 0xA282EAD8) & 0xFFFFFFFF
        return (m >> 17 | m << 15) & 0xFFFFFFFF

    blobs = [b"123456789", b"", bytes(32), b"\xff" * 32, b"a"]
    assert [unmasked(int(x)) for x in records.masked_crcs(blobs)] == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43, 0xC1D04330]
    kind = records.message(a=(1, "int"), b=(2, "string"), c=(4, ("int",)))
    assert records._encoded({"a": 150, "b": "testing"}, kind) == bytes.fromhex("089601120774657374696e67")
    assert records._decoded(bytes.fromhex("089601120774657374696e672206038e029ea705"), records._readers(kind)) == {"a": 150, "b": "testing", "c": [3, 270, 86942]}
    assert records._decoded(bytes.fromhex("08ffffffffffffffffff01"), records._readers(kind))["a"] == -1


def test_messages_round_trip(spark, tmp_path):
    rows = [("é", -3, -(1 << 63), 1.5, -0.1, True, "B", b"\x00\xff", [1, -1, 1 << 40], (7, ["x", ""]), [(1,), (None,)]), ("", 0, 0, 0.0, 0.0, False, "A", b"", [], (None, []), []), (None,) * 8 + ([], None, [])]
    df = spark.createDataFrame(rows, PLAIN)
    for compression in ("none", "gzip"):
        out = str(tmp_path / compression)
        records.write_messages(df.repartition(2), out, KIND, compression)
        back = records.read_messages(spark, out, KIND)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert [p for p in (tmp_path / "none").iterdir() if p.name.startswith("_temporary")] == []
    records.write_messages(df.limit(0), str(tmp_path / "empty"), KIND)
    assert records.read_messages(spark, str(tmp_path / "empty"), KIND).count() == 0


def test_unknown_fields_merged_messages_and_errors(spark):
    inner = lambda x: bytes([82, 2, 8, x])
    values = [inner(1) + inner(2) + bytes([210, 15, 1, 65]), b"\x0a\x05ab", b"\x0b", b"\x11" + bytes(8), b"\x80" * 12, None, b"", b"\x38\x09"]
    got = records.decode(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, value binary"), KIND, keep=("n",)).orderBy("n").collect()
    assert got[0]["inner"]["x"] == 2 and got[0]["error"] is None
    assert [r["error"] is None for r in got] == [True, False, False, False, False, False, True, True]
    assert got[6]["s"] is None and got[6]["many"] == [] and got[7]["e"] == "9"


def test_checksums_and_cut_files(spark, tmp_path):
    body = records._framed_records([b"one", b"", b"three" * 100])
    (tmp_path / "good.tfrecord").write_bytes(body)
    (tmp_path / "packed.tfrecord.gz").write_bytes(gzip.compress(body))
    (tmp_path / "none.tfrecord").write_bytes(b"")
    for name in ("good.tfrecord", "packed.tfrecord.gz"):
        got = records.tf_records(spark, str(tmp_path / name)).orderBy("place").collect()
        assert [(r["place"], bytes(r["value"])) for r in got] == [(0, b"one"), (1, b""), (2, b"three" * 100)]
    assert records.tf_records(spark, str(tmp_path / "none.tfrecord")).count() == 0
    (tmp_path / "wrong.tfrecord").write_bytes(body[:13] + b"X" + body[14:])
    (tmp_path / "cut.tfrecord").write_bytes(body[:-1])
    for name in ("wrong.tfrecord", "cut.tfrecord"):
        with pytest.raises(Exception, match="checksum|ends inside"):
            records.tf_records(spark, str(tmp_path / name)).collect()
    assert records.tf_records(spark, str(tmp_path / "wrong.tfrecord"), check=False).count() == 3


def test_fixed_length_features(spark):
    feature = lambda name, of, values: {"key": name, "value": {of: {"value": values}}}
    made = [[feature("ids", "int64_list", [1, 2]), feature("w", "float_list", [0.5])], [feature("ids", "int64_list", [3, 4]), feature("name", "bytes_list", [b"n"])]]
    values = [(records._encoded({"features": {"feature": f}}, records.EXAMPLE),) for f in made]
    df = spark.createDataFrame(values, "value binary")
    rules = {"ids": ("int", 2, None), "w": ("float", 1, 1.0), "name": ("bytes", 1, ""), "pad": ("int", 3, 0)}
    got = sorted(records.examples(df, rules).collect())
    assert [(r["ids"], r["w"], bytes(r["name"]), r["pad"]) for r in got] == [([1, 2], 0.5, b"", [0, 0, 0]), ([3, 4], 1.0, b"n", [0, 0, 0])]
    for rule in ({"ids": ("int", 3, 0)}, {"name": ("bytes", 1, None)}):
        with pytest.raises(Exception, match="feature"):
            records.examples(df, rule).collect()


def test_inputs_by_ending(spark, tmp_path):
    table = {"columns": [{"text": "A"}], "rows": [{"cells": [{"text": "1", "numeric_value": {"float_value": 1.0}}]}], "table_id": "t"}
    blob = records._encoded(table, records.TABLE)
    (tmp_path / "t.tfrecord").write_bytes(records._framed_records([blob]))
    got = records.inputs(spark, str(tmp_path / "t.tfrecord"), "table").first()
    assert got["id"] == "t" and got["questions"] == [] and got["table"]["rows"][0]["cells"][0]["numeric_value"]["float_value"] == 1.0
    sinks.messages(records.inputs(spark, str(tmp_path / "t.tfrecord"), "table"), str(tmp_path / "m.txtpb"))
    again = records.inputs(spark, str(tmp_path / "m.txtpb")).first()
    assert again["id"] == "t" and again["table"]["columns"][0]["text"] == "A"
    with pytest.raises(ValueError, match="ending"):
        records.inputs(spark, str(tmp_path / "t.csv"))


def test_a_broken_text_message_is_an_error(spark, tmp_path):
    (tmp_path / "m.txtpb").write_text('id: "1"\nid: {\nid: "3"\n')
    with pytest.raises(Exception, match="cannot be read"):
        records.inputs(spark, str(tmp_path / "m.txtpb")).collect()
