"""TFRecord files and the protocol-buffer messages in them.

A message type is a Spark struct whose fields carry their numbers (``message``), so decoded rows are
ordinary nested columns and one decoder serves every type.
"""

from __future__ import annotations

import dataclasses
import functools
import gzip
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_SIMPLE = {"string": T.StringType(), "binary": T.BinaryType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_VARINT, _EIGHT, _COUNTED, _FOUR = 0, 1, 2, 5


def message(**fields) -> T.StructType:
    """A message type: ``name=(number, kind)``. A kind is a simple type's name, a message, a list of names (an enum), or a one-element tuple of a kind (repeated)."""

    def spark_type(kind):
        if isinstance(kind, tuple):
            return T.ArrayType(spark_type(kind[0]))
        return T.StringType() if isinstance(kind, list) else _SIMPLE[kind] if isinstance(kind, str) else kind

    def enum(kind):
        kind = kind[0] if isinstance(kind, tuple) else kind
        return {"names": kind} if isinstance(kind, list) else {}

    return T.StructType([T.StructField(name, spark_type(kind), True, {"number": number, **enum(kind)}) for name, (number, kind) in fields.items()])


# Names, numbers and kinds of the message format.
DATE = message(year=(1, "int"), month=(2, "int"), day=(3, "int"))
NUMERIC = message(float_value=(1, "float"), date=(2, DATE))
NUMERIC_SPAN = message(begin_index=(1, "int"), end_index=(2, "int"), values=(3, (NUMERIC,)))
CELL = message(text=(1, "string"), numeric_value=(2, NUMERIC))
TABLE = message(
    columns=(1, (CELL,)), rows=(2, (message(cells=(1, (CELL,))),)), table_id=(3, "string"), document_title=(4, "string"), caption=(5, "string"),
    document_url=(6, "string"), alternative_document_urls=(7, ("string",)), alternative_table_ids=(8, ("string",)), context_heading=(9, "string"),
)
ANSWER = message(
    answer_coordinates=(1, (message(row_index=(1, "int"), column_index=(2, "int")),)), aggregation_function=(2, ["NONE", "SUM", "AVERAGE", "COUNT"]),
    answer_texts=(3, ("string",)), float_value=(4, "float"), is_valid=(5, "boolean"), class_index=(6, "int"),
)
QUESTION = message(
    id=(1, "string"), text=(2, "string"), original_text=(3, "string"), annotations=(4, message(spans=(1, (NUMERIC_SPAN,)))),
    answer=(5, ANSWER), alternative_answers=(6, (ANSWER,)),
)
INTERACTION = message(id=(1, "string"), table=(2, TABLE), questions=(3, (QUESTION,)))
_FEATURE = message(bytes_list=(1, message(value=(1, ("binary",)))), float_list=(2, message(value=(1, ("float",)))), int64_list=(3, message(value=(1, ("long",)))))
EXAMPLE = message(features=(1, message(feature=(1, (message(key=(1, "string"), value=(2, _FEATURE)),)))))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint of more than ten bytes")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _from_varint(kind: T.DataType, names, value: int):
    if names is not None:
        return names[value] if value < len(names) else str(value)
    if isinstance(kind, T.BooleanType):
        return value != 0
    return struct.unpack("<i", struct.pack("<I", value & 0xFFFFFFFF))[0] if isinstance(kind, T.IntegerType) else _signed(value)


@dataclasses.dataclass(frozen=True)
class _Reader:
    """What a field number of a message means."""

    name: str
    kind: T.DataType
    repeated: bool
    names: tuple | None
    inner: dict | None


def _readers(kind: T.StructType) -> dict[int, _Reader]:
    out = {}
    for f in kind.fields:
        one = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        names = f.metadata.get("names")
        out[f.metadata["number"]] = _Reader(f.name, one, isinstance(f.dataType, T.ArrayType), tuple(names) if names else None, _readers(one) if isinstance(one, T.StructType) else None)
    return out


def _wire(kind: T.DataType) -> int:
    return _EIGHT if isinstance(kind, T.DoubleType) else _FOUR if isinstance(kind, T.FloatType) else _COUNTED if isinstance(kind, (T.StringType, T.BinaryType, T.StructType)) else _VARINT


def _whole(reader: _Reader, data: bytes):
    if reader.inner is not None:
        return _decoded(data, reader.inner)
    return data.decode("utf-8", "replace") if isinstance(reader.kind, T.StringType) else data


def _packed(reader: _Reader, data: bytes) -> list:
    if isinstance(reader.kind, (T.FloatType, T.DoubleType)):
        return np.frombuffer(data, "<f4" if isinstance(reader.kind, T.FloatType) else "<f8").tolist()
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(_from_varint(reader.kind, reader.names, value))
    return out


def _decoded(data: bytes, readers: dict[int, _Reader]) -> dict:
    out: dict = {r.name: [] for r in readers.values() if r.repeated}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire, reader = tag & 7, readers.get(tag >> 3)
        if wire == _VARINT:
            raw, at = _varint(data, at)
        elif wire == _COUNTED:
            size, at = _varint(data, at)
            raw, at = data[at : at + size], at + size
        elif wire in (_FOUR, _EIGHT):
            size = 4 if wire == _FOUR else 8
            raw, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if at > len(data):
            raise ValueError("a message ends inside a field")
        if reader is None:
            continue  # an unknown field, such as an extension
        wanted = _VARINT if reader.names else _wire(reader.kind)
        if wire == _COUNTED and wanted != _COUNTED:
            values = _packed(reader, raw)
        elif wire != wanted:
            raise ValueError(f"field {reader.name} has wire type {wire}")
        else:
            values = [_from_varint(reader.kind, reader.names, raw) if wire == _VARINT else _whole(reader, raw) if wire == _COUNTED else struct.unpack("<f" if wire == _FOUR else "<d", raw)[0]]
        if reader.repeated:
            out[reader.name] += values
        elif values:
            old = out.get(reader.name)
            out[reader.name] = _merged(old, values[-1], reader.inner) if reader.inner is not None and old else values[-1]
    return out


def _merged(old: dict, new: dict, readers: dict[int, _Reader]) -> dict:
    """A single message met twice: later fields win, repeated ones are joined."""
    out = dict(old)
    for r in readers.values():
        if r.repeated:
            out[r.name] = old[r.name] + new[r.name]
        elif r.name in new:
            out[r.name] = _merged(old[r.name], new[r.name], r.inner) if r.inner is not None and r.name in old else new[r.name]
    return out


def _put(value: int) -> bytes:
    value &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _encoded(value: dict, kind: T.StructType) -> bytes:
    out = []
    for f in sorted(kind.fields, key=lambda f: f.metadata["number"]):
        repeated = isinstance(f.dataType, T.ArrayType)
        one = f.dataType.elementType if repeated else f.dataType
        names = f.metadata.get("names")
        wire = _VARINT if names else _wire(one)
        tag = _put(f.metadata["number"] << 3 | wire)
        for v in (value.get(f.name) or []) if repeated else [value.get(f.name)]:
            if v is None:
                continue
            if wire == _VARINT:
                if names and v not in names and not v.isdecimal():
                    raise ValueError(f"{f.name} has no value {v}")
                out.append(tag + _put((names.index(v) if v in names else int(v)) if names else int(v)))
            elif wire == _COUNTED:
                body = _encoded(v, one) if isinstance(one, T.StructType) else v.encode() if isinstance(one, T.StringType) else bytes(v)
                out.append(tag + _put(len(body)) + body)
            else:
                out.append(tag + struct.pack("<f" if wire == _FOUR else "<d", v))
    return b"".join(out)


@functools.cache
def _crc_table() -> np.ndarray:
    """CRC-32C (Castagnoli), bits reversed: the remainders of all bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0x82F63B78), table >> 1)
    return table


def masked_crcs(blobs: list[bytes]) -> np.ndarray:
    """The masked CRC-32C that the format wants of each blob, all blobs in step."""
    order = sorted(range(len(blobs)), key=lambda i: -len(blobs[i]))
    sizes = np.array([len(blobs[i]) for i in order], dtype=np.int64)
    flat = np.frombuffer(b"".join(blobs[i] for i in order), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    crc, table = np.full(len(blobs), 0xFFFFFFFF, dtype=np.uint32), _crc_table()
    for i in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -i, side="left"))  # blobs of more than i bytes
        crc[:live] = table[(crc[:live] ^ flat[starts[:live] + i]) & 255] ^ crc[:live] >> 8
    crc ^= np.uint32(0xFFFFFFFF)
    out = np.empty_like(crc)
    out[order] = (crc >> 15 | crc << 17) + np.uint32(0xA282EAD8)
    return out


def _frames(data: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Length field, body and both checksums of each record."""
    at = 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a record file ends inside a length")
        size, of_size = struct.unpack_from("<QI", data, at)
        end = at + 12 + size
        if end + 4 > len(data):
            raise ValueError("a record file ends inside a record")
        yield data[at : at + 8], data[at + 12 : end], of_size, struct.unpack_from("<I", data, end)[0]
        at = end + 4


#: Records checked and handed on at a time.
_TOGETHER = 1024


def tf_records(spark: SparkSession, path: str | list[str], check: bool = True) -> DataFrame:
    """Records of TFRecord files, plain or gzip: ``(file, place, value binary)``, ``place`` counted from 0 in a file.

    Spark's own file scan reads them, so any path that Spark knows will do. The format cannot be split: a file is one
    task's work and at most 2 GB, so large sets belong in many files. A wrong checksum or a cut file raises
    unless ``check`` is off (cut files raise always); an empty file has no records.
    """

    def read(batches):
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = content.as_buffer().to_pybytes()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" and not _framed(data) else data
                place, group = 0, []
                for frame in _frames(data):
                    group.append(frame)
                    if len(group) == _TOGETHER:
                        yield out(file, place, group)
                        place, group = place + len(group), []
                if group:
                    yield out(file, place, group)

    def out(file, place, group):
        if check:
            for column, crcs in ((0, 2), (1, 3)):
                wrong = np.flatnonzero(masked_crcs([g[column] for g in group]) != np.array([g[crcs] for g in group], dtype=np.uint32))
                if len(wrong):
                    raise ValueError(f"record {place + int(wrong[0])} of {file} has a wrong checksum")
        places = pa.array(range(place, place + len(group)), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([file] * len(group), pa.string()), places, pa.array([g[1] for g in group], pa.binary())], ["file", "place", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, place long, value binary")


def _framed(data: bytes) -> bool:
    """Whether the first length's checksum is right, so that it is no gzip file."""
    return len(data) >= 12 and int(masked_crcs([data[:8]])[0]) == struct.unpack_from("<I", data, 8)[0]


def decode(records: DataFrame, kind: T.StructType, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages in a binary column as the columns of ``kind``, and ``error``: why a row is no message (null: it is one).

    Unset fields are null, repeated ones empty; numbers that ``kind`` does not name are passed over. A null value
    gives a row of nulls with an error. ``keep`` names columns that go along.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    plain = T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields])
    inner, fields = to_arrow_type(plain), _readers(kind)
    kept = [records.schema[c] for c in keep]
    names = [*keep, *[f.name for f in kind.fields], "error"]

    def read(batches):
        for batch in batches:
            found, errors = [], []
            for data in batch[value].to_pylist():
                try:
                    found.append(_decoded(data, fields) if data is not None else None)
                    errors.append("null" if data is None else None)
                except (ValueError, IndexError, struct.error) as e:
                    found.append(None)
                    errors.append(str(e))
            structs = pa.array([{} if x is None else x for x in found], inner)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *structs.flatten(), pa.array(errors, pa.string())], names)

    out = T.StructType([*kept, *plain.fields, T.StructField("error", T.StringType())])
    return records.select(*keep, value).mapInArrow(read, out)


def encode(df: DataFrame, kind: T.StructType) -> DataFrame:
    """Rows as messages: ``(value binary)``. Columns of ``kind`` that ``df`` lacks stay unset, others of ``df`` are left out."""
    there = [f for f in kind.fields if f.name in df.columns]
    kind = T.StructType(there)

    def write(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_encoded(row, kind) for row in batch.to_pylist()], pa.binary())], ["value"])

    return df.select(*[f.name for f in there]).mapInArrow(write, "value binary")


def read_messages(spark: SparkSession, path: str | list[str], kind: T.StructType = INTERACTION) -> DataFrame:
    """Messages of TFRecord files, dealt out anew as a file is a single task's; raises on a record that is none."""
    rows = decode(tf_records(spark, path), kind)
    first = kind.fields[0].name
    failed = F.raise_error(F.concat(F.lit("not a message: "), "error"))
    return rows.withColumn(first, F.when(F.col("error").isNotNull(), failed).otherwise(F.col(first))).drop("error")


def examples(records: DataFrame, features: dict[str, tuple[str, int, object]], value: str = "value") -> DataFrame:
    """Fixed-length features of ``Example`` messages: ``name: (int | float | bytes, length, default)``.

    A column per feature: a value for length 1, else an array. A missing feature is its default, repeated; without a
    default (None) it raises, as does a feature of another length. ``int`` features are 32-bit.
    """
    lists = {"int": ("int64_list", "int"), "float": ("float_list", "float"), "bytes": ("bytes_list", "binary")}
    rows = decode(records, EXAMPLE, value)
    by_name = rows.select("error", F.map_from_entries(F.transform("features.feature", lambda e: F.struct(e["key"], e["value"]))).alias("_f"))

    def one(name: str, kind: str, length: int, default) -> Column:
        of, type_name = lists[kind]
        found = F.element_at("_f", F.lit(name))[of]["value"].cast(f"array<{type_name}>")
        wrong = lambda why: F.raise_error(F.lit(f"feature {name}: {why}"))
        missing = wrong("missing and without a default") if default is None else F.array_repeat(F.lit(default).cast(type_name), length)
        got = F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, missing).when(F.size(found) != length, wrong(f"not of length {length}")).otherwise(found)
        return (got[0] if length == 1 else got).alias(name)

    bad = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("not an example: "), "error"))).otherwise(F.col("_f"))
    return by_name.select(bad.alias("_f")).select(*[one(name, *rule) for name, rule in features.items()])


@dataclasses.dataclass
class _Part(WriterCommitMessage):
    name: str


class _RecordWriter(DataSourceWriter):
    """A hidden folder of parts, moved to the target when all tasks are done; a retried task writes a part of its own."""

    def __init__(self, path: str, compressed: bool):
        self.path, self.compressed = path.rstrip("/"), compressed
        self.hidden = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def _files(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, rows) -> _Part:
        files, folder = self._files(self.hidden)
        files.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tfrecord" + (".gz" if self.compressed else "")
        with files.open_output_stream(f"{folder}/{name}", compression="gzip" if self.compressed else None) as out:
            group: list[bytes] = []
            for row in rows:
                group.append(bytes(row[0]))
                if len(group) == _TOGETHER:
                    out.write(_framed_records(group))
                    group = []
            out.write(_framed_records(group))
        return _Part(name)

    def commit(self, messages) -> None:
        files, folder = self._files(self.hidden)
        _, target = self._files(self.path)
        for m in messages:
            if m is not None:
                files.move(f"{folder}/{m.name}", f"{target}/{m.name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        files, folder = self._files(self.hidden)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


def _framed_records(blobs: list[bytes]) -> bytes:
    sizes = [struct.pack("<Q", len(b)) for b in blobs]
    crcs = zip(sizes, masked_crcs(sizes).tolist(), blobs, masked_crcs(blobs).tolist())
    return b"".join(size + struct.pack("<I", a) + blob + struct.pack("<I", b) for size, a, blob, b in crcs)


class TFRecordSink(DataSource):
    """``df.write.format("tfrecord_sink")``: a binary column as TFRecord files."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord_sink"

    def schema(self) -> str:
        return "value binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _RecordWriter(self.options["path"], self.options.get("compression", "none") == "gzip")


def write_records(values: DataFrame, path: str, compression: str = "none") -> None:
    """A binary column, ``value``, as TFRecord files, one a partition; nulls raise. Files are added to a folder.

    The folder must be one that pyarrow's file systems reach (local or shared folders, HDFS, object stores).
    """
    if compression not in ("none", "gzip"):
        raise ValueError(f"unknown compression {compression}")
    values.sparkSession.dataSource.register(TFRecordSink)
    there = F.when(F.col("value").isNull(), F.raise_error(F.lit("a null record")).cast("binary")).otherwise(F.col("value"))
    values.select(there.alias("value")).write.format("tfrecord_sink").option("compression", compression).mode("append").save(path)


def write_messages(df: DataFrame, path: str, kind: T.StructType = INTERACTION, compression: str = "none") -> None:
    """Rows as messages in TFRecord files."""
    write_records(encode(df, kind), path, compression)


def tables_as_interactions(tables: DataFrame) -> DataFrame:
    """Table messages as interactions without questions, named by their table."""
    return tables.select(F.col("table_id").alias("id"), F.struct(*[f.name for f in TABLE.fields]).alias("table"), F.array().cast(INTERACTION["questions"].dataType).alias("questions"))


def inputs(spark: SparkSession, path: str, kind: str = "interaction") -> DataFrame:
    """``(id, table, questions)`` from TFRecord or text-format files of interactions or tables, by the path's ending.

    Rows are dealt out by id, as neither form can be split. A message that cannot be read is an error in both forms;
    :func:`.readers.text_messages` returns errors beside the others. An unknown ending raises.
    """
    from .readers import text_messages

    what = {"interaction": INTERACTION, "table": TABLE}[kind]
    plain = path[: -len(".gz")] if path.endswith(".gz") else path
    if plain.endswith((".tfrecord", ".tfrecords")):
        rows = read_messages(spark, path, what)
    elif plain.endswith(".txtpb"):
        read, name = text_messages(spark, path, what), "id" if kind == "interaction" else "table_id"
        broken = F.raise_error(F.concat(F.lit("a message that cannot be read: "), F.col("error")))
        rows = read.withColumn(name, F.when(F.col("error").isNotNull(), broken).otherwise(F.col(name))).drop("error")
    else:
        raise ValueError(f"unknown ending: {path}")
    rows = rows if kind == "interaction" else tables_as_interactions(rows)
    return rows.repartition("id")
