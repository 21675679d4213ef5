"""Corpus statistics looked up block by block.

Looking up one number for every word occurrence by a join moves a row per occurrence. Instead the
documents are dealt into blocks of a bounded size; a block asks for each distinct key once, keys travel
as sorted and packed arrays (a few bytes each, one row for each block and key range), and the answers
come back to the block that asked. ``ask`` and ``answer`` are the callers' functions on such arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of text in a block, at most, on average.
BLOCK_BYTES = 12_000_000
#: UTF-8 bytes of text for each range of the key space; keys of one range meet in one group (of a few million).
RANGE_BYTES = 48_000_000
LEAST_RANGES = 64
#: Bytes of text for which an id counts once more when blocks are cut.
WEIGHT = 4096
#: Ranges of ids whose bounds come to the driver, at most.
WIDE_RANGES = 1024
#: Blocks whose bounds (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 16_000_000


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def ranges_for(size: int) -> int:
    """Number of key ranges, a power of two. Blocks times ranges bounds the rows of an exchange."""
    return max(LEAST_RANGES, 1 << max(0, math.ceil(math.log2(max(1, size) / RANGE_BYTES))))


def with_block(docs: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Adds ``block``: ranges of ``id_col`` of about equal text bytes, ids of one value together; and how many there are.

    An id stands in the quantiles once for every ``WEIGHT`` bytes of its text, so long texts fill a block sooner.
    The driver gets the bounds of at most ``WIDE_RANGES`` ranges. Where more blocks are asked for, each of
    these is cut again, by bounds that stay in a table: 8 bytes for each block, joined by range number.
    Rows of a null id are in no range: they are dealt to all blocks by their text.
    """
    n = max(2 * shuffle_partitions(docs), math.ceil(size / block_bytes))
    inner = math.ceil(n / WIDE_RANGES)
    outer = math.ceil(n / inner)
    points = lambda m: [i / m for i in range(1, m)]
    at = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    weight = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) / WEIGHT).cast("int") + 1
    ids = docs.where(F.col(id_col).isNotNull()).select(F.explode(F.array_repeat(at, weight)).alias("_at"))
    bounds = ids.agg(F.percentile_approx("_at", points(outer), 20 * outer)).first()[0] or []
    bounds = sorted(set(bounds))
    stray = F.pmod(F.xxhash64(text_col), F.lit(n)).cast("int")
    dealt = lambda found: F.when(F.col(id_col).isNull(), stray).otherwise(found)
    if inner == 1:
        return docs.withColumn("block", dealt(_range_of(at, bounds))), n
    ids = ids.withColumn("_wide", _range_of(F.col("_at"), bounds))
    cuts = ids.groupBy("_wide").agg(F.array_distinct(F.percentile_approx("_at", points(inner), 20 * inner)).alias("_cuts"))
    cuts = F.broadcast(cuts) if n <= BROADCAST_BLOCKS else cuts
    fine = F.coalesce(F.size(F.filter("_cuts", lambda b: b < F.col("_at"))), F.lit(0))
    return (
        docs.withColumns({"_at": at, "_wide": _range_of(at, bounds)}).join(cuts, "_wide", "left")
        .withColumn("block", dealt((F.col("_wide") * inner + fine).cast("int"))).drop("_at", "_wide", "_cuts")
    ), n


def _range_of(x: Column, bounds: list[int]) -> Column:
    """Number of bounds below ``x``, found in two levels so that a row costs 2 * sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    array = lambda xs: F.array(*[F.lit(int(v)) for v in xs]).cast("array<bigint>")
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda a: F.size(F.filter(a, lambda b: b < x))
    coarse = below(array([r[0] for r in rows]))
    inner = F.element_at(F.array(*[array(r) for r in rows]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + below(inner)).cast("int")


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 as differences of 4, 5, 6 or 8 bytes."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    head, rest = keys[:1].astype("<u8").tobytes(), steps[1:]
    top = int(rest.max()) if len(rest) else 0
    width = 4 if top < 1 << 32 else 5 if top < 1 << 40 else 6 if top < 1 << 48 else 8
    body = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + head + np.ascontiguousarray(body).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype=np.uint64)
    width = blob[0]
    body = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(body) + 1, 8), dtype=np.uint8)
    out[0] = np.frombuffer(blob, dtype=np.uint8, count=8, offset=1)
    out[1:, :width] = body
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """Slices of sorted keys that fall into one range, by the keys' upper bits."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(65 - ranges.bit_length())).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return [(int(part[a]), slice(a, b)) for a, b in zip(edges, edges[1:])]


ASKED = "part int, block int, keys binary, extra binary"
ANSWERED = "block int, part int, keys binary, extra binary"


def asked(rows: list[tuple[int, int, bytes, bytes]], names: tuple[str, ...] = ("part", "block", "keys", "extra")) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, cols, kinds)})


def answered(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    return asked(rows, ("block", "part", "keys", "extra"))


def exchange(blocks: DataFrame, ranges: int, ask: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``ask`` on every block, then ``answer`` on every one of about ``ranges`` key ranges: rows of ``ANSWERED``.

    Key ranges are dealt to a number of tasks that follows theirs, so no task's input grows with the corpus.
    """
    questions = blocks.groupBy("block").applyInArrow(ask, ASKED)
    return questions.repartition(max(shuffle_partitions(blocks), ranges // 4), "part").groupBy("part").applyInArrow(answer, ANSWERED)
