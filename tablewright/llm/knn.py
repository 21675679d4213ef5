"""Exact top-k inner products with a KD-tree per shard.

Every shard of the candidates gets one tree, through which all queries stream: median splits along the widest
side, tight bounding boxes at every node. A query descends best-first: the heap holds nodes by the largest inner product that a point of
their box can reach, and the search ends when that bound falls below the k-th score. A first round runs
each query in one shard only; its k-th score is propagated to all other shards, which then cut boxes by it.
Bounds are compared with ``<``, so equal scores are still visited and ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._blocks import shuffle_partitions
from ._store import checkpoint

LEAF = 128


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """``(vec_id, q array<long>, dim)`` with components floor(scale * x) in double.

    Null ids, null vectors, empty ones and vectors with a null or non-finite component are left out. Components
    beyond the 64-bit range are held at its ends.
    """
    x = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * float(scale))).cast("array<bigint>").alias("q"), F.size(x).alias("dim")
    )


class KDTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        if len(points):
            self._build(0, len(points))

    def _build(self, a: int, b: int) -> int:
        node, rows = len(self.lo), self.points[self.order[a:b]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.span.append((a, b))
        self.kids.append(())
        if b - a > self.leaf and (hi > lo).any():
            axis, mid = int(np.argmax(hi - lo)), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
            self.kids[node] = (self._build(a, a + mid), self._build(a + mid, b))
        return node

    def bound(self, node: int, q: np.ndarray):
        return np.maximum(q * self.lo[node], q * self.hi[node]).sum()

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, floor=None) -> list[tuple]:
        """At most ``k`` pairs (score, row) that reach ``floor``: largest score first, ties to smaller ids."""
        best: list[tuple] = []  # a heap of (score, -id, row), least first
        if not self.lo:
            return best
        todo = [(-self.bound(0, q), 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -bound < least:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if least is None or self.bound(kid, q) >= least:
                        heapq.heappush(todo, (-self.bound(kid, q), kid))
                continue
            rows = self.order[slice(*self.span[node])]
            scores = self.points[rows] @ q
            keep = ids[rows] != own
            if least is not None:
                keep &= scores >= least
            rows, scores = rows[keep], scores[keep]
            if len(rows) > k:
                pick = np.lexsort((ids[rows], -scores))[:k]
                rows, scores = rows[pick], scores[pick]
            for found in zip(scores.tolist(), (-ids[rows]).tolist(), rows.tolist()):
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return [(s, row) for s, _, row in sorted(best, reverse=True)]


def _matrix(col: pa.Array, dim: int, wide: bool) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return flat.astype(object) if wide else flat.astype(np.float64)


def _top(col: pa.Array) -> float:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return float(np.abs(flat.astype(np.float64)).max()) if len(flat) else 0.0


class _Shard:
    """A shard's points, of which a tree is built when the first query comes: once, in doubles or in Python's integers."""

    def __init__(self, dim: int):
        self.dim, self.q, self.ids, self.copies, self.trees = dim, [], [], [], {}

    def add(self, rows: pa.RecordBatch) -> None:
        self.q.append(rows.column("q"))
        self.ids.append(rows.column("vec_id").to_numpy())
        self.copies.append(rows.column("copies").to_numpy())

    def search(self, rows: pa.RecordBatch, k: int) -> list[tuple]:
        if not self.ids:
            return []
        if not self.trees:
            self.points, self.ids, self.copies = pa.concat_arrays(self.q), [np.concatenate(self.ids)], [np.concatenate(self.copies)]
            self.top = _top(self.points)
        wide = self.top * _top(rows.column("q")) * self.dim >= 2**52  # beyond the whole numbers that doubles hold
        if wide not in self.trees:
            self.trees[wide] = KDTree(_matrix(self.points, self.dim, wide))
        out, ids, copies = [], self.ids[0], self.copies[0]
        for query, own, key, floor in zip(_matrix(rows.column("q"), self.dim, wide), rows.column("vec_id").to_pylist(), rows.column("ask").to_pylist(), rows.column("floor").to_pylist()):
            for s, at in self.trees[wide].search(query, ids, own, k, floor):
                out.append((own, key, int(ids[at]), max(-(2**63), min(2**63 - 1, int(s))), int(copies[at])))
        return out


_FOUND = "query_id long, ask long, vec_id long, score long, copies long"


def _stream(k: int):
    def run(batches):
        """Rows come shard by shard, its points first, then its queries."""
        names, key, shard = [c.split()[0] for c in _FOUND.split(", ")], None, None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            found: list[tuple] = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                dim, number, kind = marks[:, a].tolist()
                if (dim, number) != key:
                    key, shard = (dim, number), _Shard(dim)
                if kind == 0:
                    shard.add(batch.slice(a, b - a))
                else:
                    found += shard.search(batch.slice(a, b - a), k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    return run


def top_k(queries: DataFrame, points: DataFrame, k: int = 10, shard_rows: int = 8_192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best other points, all if there are fewer.

    Both sides as from :func:`quantised`. A point with the query's own id is no candidate; vectors of another
    dimension than the query's take no part in it. Repeated points stay separate candidates (they are searched
    once and counted as often as they occur), repeated queries are asked once, and queries of one id with other
    vectors have ranks of their own. Equal scores go to the smaller id. Scores beyond 64 bits are held at the
    range's ends; such points rank by their true scores, and among points of one held score by id. Empty tables
    give no rows; other columns play no part.

    Shards hold about ``shard_rows`` points, dealt by id and vector; a task keeps one shard's tree and streams all
    queries through it, so no side is broadcast. Work is queries times points by the statement of the search;
    data moved is every point twice plus queries times shards.
    """
    counted = checkpoint(points.groupBy("vec_id", "q", "dim").agg(F.least(F.count("*"), F.lit(k)).alias("copies")))
    asks = checkpoint(queries.select("vec_id", "q", "dim").distinct().withColumn("ask", F.xxhash64("q")))
    n = counted.count()
    shards = max(min(2 * shuffle_partitions(points), math.ceil(n / 256)), math.ceil(n / shard_rows), 1)
    home = F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).cast("int")
    none = F.lit(None).cast("long")
    stored = counted.select("dim", home.alias("shard"), F.lit(0).alias("kind"), "vec_id", "q", "copies", none.alias("ask"), none.alias("floor"))

    def run(asked: DataFrame) -> DataFrame:
        rows = stored.unionByName(asked.select("dim", "shard", F.lit(1).alias("kind"), "vec_id", "q", none.alias("copies"), "ask", "floor"))
        return rows.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind").mapInArrow(_stream(k), _FOUND)

    ask = ["query_id", "ask"]
    pilot = checkpoint(run(asks.withColumn("shard", home).withColumn("floor", none)))
    known = pilot.groupBy(*ask).agg(F.min("score").alias("floor"), F.count("*").alias("_n")).where(F.col("_n") >= k).drop("_n").withColumnRenamed("query_id", "vec_id")
    others = asks.join(known, ["vec_id", "ask"], "left").withColumn("home", home).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    found = pilot.unionByName(run(others)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = Window.partitionBy(*ask).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
