"""An endless stream over Parquet files: every epoch holds each row once, in a seeded order of its own.

A place in the stream is ``(epoch, position)``. The rows of the files, in their order, are cut into buffers of
``buffer`` rows; an epoch's order is a seeded permutation of the buffers and, inside each, one of its rows. So the row at
a place is a function of the place alone: a stream that is stopped goes on exactly where it was, however its batches are
cut, and a task reads the row groups of its own buffers only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def parquet_files(path: str) -> list[tuple[str, list[int]]]:
    """``(file, rows of its row groups)`` of a file or of a folder's files by name; files begun with ``_`` or ``.`` are none."""
    fs, at = _open(path)
    found = [fs.get_file_info(at)]
    if found[0].type == pa.fs.FileType.Directory:
        found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    names = sorted(f.path for f in found if f.is_file and f.base_name[0] not in "_.")
    out = []
    for name in names:
        meta = pq.ParquetFile(fs.open_input_file(name)).metadata
        out.append((name, [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]))
    return out


@dataclass(frozen=True)
class Order:
    """The order of ``rows`` rows in each epoch."""

    rows: int
    buffer: int
    seed: int

    @property
    def buffers(self) -> int:
        return -(-self.rows // self.buffer)

    def blocks(self, epoch: int) -> tuple[np.ndarray, np.ndarray]:
        """(buffers in the epoch's order, the position at which each begins, and the end)."""
        turn = np.random.default_rng([self.seed, epoch]).permutation(self.buffers)
        sizes = np.minimum(self.rows, (turn + 1) * self.buffer) - turn * self.buffer
        return turn, np.concatenate([[0], np.cumsum(sizes)])

    def inside(self, epoch: int, block: int) -> np.ndarray:
        """The rows of a buffer, as places in the files, in the epoch's order."""
        first, end = block * self.buffer, min(self.rows, (block + 1) * self.buffer)
        return first + np.random.default_rng([self.seed, epoch, block]).permutation(end - first)


class Buffer(InputPartition):
    """Positions ``begin`` to ``end`` of one epoch, all of one buffer; ``skip`` of its rows come before them."""

    def __init__(self, epoch: int, block: int, begin: int, end: int, skip: int):
        super().__init__(epoch)
        self.epoch, self.block, self.begin, self.end, self.skip = epoch, block, begin, end, skip


class Reader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.files = parquet_files(self.path)
        total = sum(sum(groups) for _, groups in self.files)
        self.order = Order(total, int(options.get("buffer", 10_000)), int(options.get("seed", 0)))
        self.step, self.epochs = int(options.get("rowsPerBatch", 100_000)), int(options.get("epochs", 0))
        self.at = (0, 0)

    def initialOffset(self) -> dict:
        return {"epoch": 0, "position": 0}

    def _after(self, at: tuple[int, int], rows: int) -> tuple[int, int]:
        if not self.order.rows:
            return at
        place = at[0] * self.order.rows + at[1] + rows
        if self.epochs:
            place = min(place, self.epochs * self.order.rows)
        return divmod(place, self.order.rows)

    def latestOffset(self) -> dict:
        """One batch further than the last answer; what Spark has asked for since then counts as answered."""
        self.at = self._after(self.at, self.step)
        return {"epoch": self.at[0], "position": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["epoch"], start["position"]), (end["epoch"], end["position"])
        self.at = max(self.at, last)
        out = []
        for epoch in range(first[0], last[0] + 1):
            low, high = first[1] if epoch == first[0] else 0, last[1] if epoch == last[0] else self.order.rows
            if low >= high:
                continue
            turn, begins = self.order.blocks(epoch)
            for k in range(int(np.searchsorted(begins, low, "right")) - 1, len(turn)):
                begin, stop = max(low, int(begins[k])), min(high, int(begins[k + 1]))
                if begin >= stop:
                    break
                out.append(Buffer(epoch, int(turn[k]), begin, stop, begin - int(begins[k])))
        return out

    def commit(self, end: dict) -> None:
        self.at = max(self.at, (end["epoch"], end["position"]))

    def read(self, partition: Buffer) -> Iterator[pa.RecordBatch]:
        wanted = self.order.inside(partition.epoch, partition.block)[partition.skip : partition.skip + partition.end - partition.begin]
        low, high, fs, at, parts = int(wanted.min()), int(wanted.max()) + 1, _open(self.path)[0], 0, []
        names = [f.name for f in self.schema.fields[2:]]
        for name, groups in self.files:
            if at + sum(groups) > low and at < high:
                file, begin = pq.ParquetFile(fs.open_input_file(name)), at
                for i, rows in enumerate(groups):
                    if begin + rows > low and begin < high:
                        parts.append(file.read_row_group(i, columns=names).slice(max(0, low - begin), min(high, begin + rows) - max(low, begin)))
                    begin += rows
            at += sum(groups)
        rows = pa.concat_tables(parts).select(names).take(pa.array(wanted - low))
        place = pa.array(np.arange(partition.begin, partition.end))
        out = pa.table([pa.array(np.full(len(wanted), partition.epoch)), place, *rows.columns], names=["epoch", "position", *names])
        yield from out.combine_chunks().to_batches()


class ShuffledParquet(DataSource):
    """Options: ``path``; ``buffer`` (rows shuffled together), ``seed``, ``rowsPerBatch``, ``epochs`` (0: no end)."""

    @classmethod
    def name(cls) -> str:
        return "shuffled_parquet"

    def schema(self) -> StructType:
        raise ValueError("state the columns to read, after epoch and position")

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


def repeated(spark: SparkSession, path: str, seed: int = 0, buffer: int = 10_000, rows_per_batch: int = 100_000, epochs: int = 0) -> DataFrame:
    """A stream ``(epoch, position, columns of the files)``; ``epochs`` ends it, 0 does not.

    The files are listed once, by the session that starts the stream: add none while it runs. Their path must be one
    that pyarrow's file systems read on every executor.
    """
    schema = spark.read.parquet(path).schema
    full = StructType([StructField("epoch", LongType()), StructField("position", LongType()), *schema.fields])
    spark.dataSource.register(ShuffledParquet)
    src = spark.readStream.format("shuffled_parquet").schema(full)
    return src.options(path=path, seed=seed, buffer=buffer, rowsPerBatch=rows_per_batch, epochs=epochs).load()


def run_until(stream: DataFrame, out: str, checkpoint: str, rows: int, seconds: float = 300.0) -> DataFrame:
    """Runs an endless stream until ``rows`` rows have come in this run, stops it, and reads back all that it has written."""
    import time

    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    began, seen = time.time(), {}
    try:
        while sum(seen.values()) < rows and time.time() - began < seconds and query.isActive:
            time.sleep(0.2)
            seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
