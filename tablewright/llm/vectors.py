"""Embedding near-dedup: rotated binary codes with correction factors, bounds, exact recomputation.

A unit vector ``o`` is padded and rotated by one random orthogonal matrix; its code is the signs of the
rotated coordinates, i.e. the corner ``c`` of the cube nearest to it. With the stored factor ``<c, o'>`` the
quotient ``<c, q'> / <c, o'>`` estimates ``<o, q>`` without bias over the rotation, and its error stays below
``eps * sqrt(1 - f^2) / (f * sqrt(D - 1))`` with high probability. Candidates share the code's bits at one of
several random subsets; the number of bits follows the number of vectors and the number of subsets follows
the recall at the threshold. A pair whose upper bound reaches the threshold is recomputed in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cells import CELL, bundled, first_shared, pair_mask, to_cells
from ._components import components
from ._store import checkpoint


#: The trees of one dimension are numbered from a multiple of this.
_TREES = 1 << 14


class BinaryCodes:
    def __init__(self, dim: int, bits: int = 256, eps: float = 3.0, seed: int = 3):
        self.dim, self.eps = dim, eps
        self.size = self.padded(dim, bits)
        turn = np.random.default_rng([seed, dim])
        q, r = np.linalg.qr(turn.standard_normal((self.size, self.size)))
        self.rotation = (q * np.sign(np.diag(r)))[:, :dim]  # the padding meets the other columns

    @staticmethod
    def padded(dim: int, bits: int) -> int:
        return max(64, -(-max(dim, bits) // 64) * 64)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed sign bits, factors) of unit rows."""
        turned = unit @ self.rotation.T
        return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(self.size)

    def corner(self, packed: np.ndarray) -> np.ndarray:
        return (np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(self.size))

    def turn(self, queries: np.ndarray) -> np.ndarray:
        return (queries @ self.rotation.T).astype(np.float32)

    def error(self, factor: np.ndarray) -> np.ndarray:
        return self.eps * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * math.sqrt(self.size - 1))

    def estimate(self, packed: np.ndarray, factor: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of the coded rows with ``queries``, and their bounds on the error, by row."""
        return self.corner(packed) @ self.turn(queries).T / factor[:, None], self.error(factor)[:, None]


def found_share(count: int, width: int, size: int, differ: float) -> float:
    """Expected share of pairs that agree in all bits of one of ``count`` subsets, each bit differing with probability ``differ``.

    All subsets are drawn from the same bits, so their hits are independent only given the number of bits that
    differ: this is the mean over that number's binomial distribution.
    """
    k = np.arange(size + 1)
    log_fact = np.array([math.lgamma(i + 1) for i in k])
    weight = np.exp(log_fact[size] - log_fact - log_fact[::-1] + k * math.log(differ) + (size - k) * math.log1p(-differ))
    most = size - width
    hit = np.exp(log_fact[size - k[: most + 1]] - log_fact[most - k[: most + 1]] - log_fact[size] + log_fact[most])
    missed = np.ones(size + 1)
    missed[: most + 1] = (1 - np.minimum(hit, 1)) ** count
    return float((weight * (1 - missed)).sum())


def plan_bands(n: int, threshold: float, recall: float, size: int, seed: int = 4) -> list[np.ndarray]:
    """Random bit subsets: about log2(n) bits each, as many as the recall asks for at the threshold.

    Where more than ``_TREES`` would be needed, subsets have fewer bits instead, so the recall never gives way.
    """
    width = int(min(size // 4, 48, max(8, math.ceil(math.log2(max(2, n))))))
    differ = math.acos(threshold) / math.pi
    while width > 1 and found_share(_TREES - 1, width, size, differ) < recall:
        width -= 1
    least, most = 1, _TREES - 1
    while least < most:
        count = (least + most) // 2
        least, most = (least, count) if found_share(count, width, size, differ) >= recall else (count + 1, most)
    turn = np.random.default_rng([seed, width])
    return [np.sort(turn.choice(size, width, replace=False)) for _ in range(least)]


def usable(col):
    """Not null, not empty, no null or non-finite component, not zero."""
    x = col.cast("array<double>")
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)


def unit_rows(rows: list) -> np.ndarray:
    """Rows of unit length in double precision, scaled first so that no square overflows or vanishes."""
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _shared_keys(packed: np.ndarray, bands: list[np.ndarray]) -> np.ndarray:
    """The key of every row in every tree."""
    sign = np.unpackbits(packed, axis=1)
    return np.stack([_key(sign[:, s]) for s in bands], axis=1)


def _encode(bits: int, bands_by_dim: dict, seed: int):
    def run(batches):
        codes: dict[int, BinaryCodes] = {}
        for b in batches:
            rows, ids = b.column("vec").to_pylist(), b.column("id").to_pylist()
            by: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by.setdefault(len(r), []).append(i)
            out = []
            for dim, at in by.items():
                coder = codes.setdefault(dim, BinaryCodes(dim, bits, seed=seed))
                unit = unit_rows([rows[i] for i in at])
                packed, factor = coder.encode(unit)
                keys = _shared_keys(packed, bands_by_dim[dim])
                step = 1 / 127
                small = np.rint(unit / step).astype(np.int8)
                lost = np.sqrt(((unit - small * step) ** 2).sum(axis=1))
                out += [(ids[i], dim, packed[j].tobytes(), float(factor[j]), small[j].tobytes(), float(lost[j]), keys[j].tolist()) for j, i in enumerate(at)]
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "dim", "code", "factor", "small", "lost", "bands"])

    return run


def _key(bits: np.ndarray) -> np.ndarray:
    place = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
    return (bits.astype(np.uint64) * place).sum(axis=1).astype(np.int64)


#: Cells of more rows are compared as matrices, smaller ones pair by pair over all cells of a bundle at once.
_SMALL = 32


class _Reach:
    """Whether the estimate plus its bound reaches the threshold, by either's code."""

    def __init__(self, coder: BinaryCodes, table: pa.Table, packed: np.ndarray, threshold: float):
        query = np.array([np.frombuffer(x, dtype=np.int8) for x in table.column("small").to_pylist()]).astype(np.float64) / 127
        self.factor, self.lost = table.column("factor").to_numpy(), table.column("lost").to_numpy()
        self.corner, self.turned, self.error = coder.corner(packed), coder.turn(query), coder.error(self.factor)
        self.threshold = threshold

    def _by_code(self, guess, a, b):
        return guess / self.factor[a] + self.error[a] + self.lost[b] / self.factor[a] >= self.threshold

    def block(self, at: np.ndarray) -> np.ndarray:
        reach = self._by_code(self.corner[at] @ self.turned[at].T, at[:, None], at[None, :])
        return reach | reach.T

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one = lambda a, b: self._by_code((self.corner[a] * self.turned[b]).sum(axis=1), a, b)
        return one(a, b) | one(b, a)


def _near_pairs(table: pa.Table, keys: np.ndarray, tree: int, near: _Reach) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs that meet in a cell of this bundle, in no earlier tree, and are ``near``; each pair once."""
    key, lo, hi, part = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "part"))
    order = np.lexsort((hi, lo, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s, n in zip(begin[size > _SMALL], size[size > _SMALL]):
        at = order[s : s + n]
        mask = first_shared(keys[at], tree, pair_mask(part[at], lo[at[0]], hi[at[0]]))
        if mask.any():
            i, j = np.nonzero(np.triu(mask & near.block(at)))
            found.append((at[i], at[j]))
    left = np.repeat(np.where(size > _SMALL, 0, begin + size), size) - np.arange(len(order))  # rows from here to the cell's end
    for step in range(1, _SMALL):
        i = np.flatnonzero(left > step)
        if not len(i):
            break
        a, b = order[i], order[i + step]
        meet = ((lo[a] == hi[a]) | (part[a] != part[b])) & ~(keys[a, :tree] == keys[b, :tree]).any(axis=1)
        a, b = a[meet], b[meet]
        ok = near.pairs(a, b)
        found.append((a[ok], b[ok]))
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *[a for a, _ in found]]), np.concatenate([none, *[b for _, b in found]])


def _met_pairs(table: pa.Table, bits: int, bands_by_dim: dict, threshold: float, seed: int, coders: dict) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a bundle that are met here first and whose estimate plus bound reaches the threshold."""
    tree, dim = table.column("tree")[0].as_py() % _TREES, table.column("dim")[0].as_py()
    packed = np.array([np.frombuffer(x, dtype=np.uint8) for x in table.column("code").to_pylist()])
    if dim not in coders:
        coders[dim] = BinaryCodes(dim, bits, seed=seed)
    keys = _shared_keys(packed, bands_by_dim[dim][: max(1, tree)])
    return _near_pairs(table, keys, tree, _Reach(coders[dim], table, packed, threshold))


def _survivors(bits: int, bands_by_dim: dict, threshold: float, seed: int):
    coders: dict[int, BinaryCodes] = {}

    def run(table: pa.Table) -> pa.Table:
        """Rows with a pair that needs exact recomputation: only these bring their vectors."""
        a, b = _met_pairs(table, bits, bands_by_dim, threshold, seed, coders)
        keep = np.zeros(table.num_rows, dtype=bool)
        keep[a] = keep[b] = True
        return table.filter(pa.array(keep)).select([*CELL, "bundle", "id", "part"])

    return run


def cosines(unit: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """Inner products of pairs of rows in double precision, a bounded number of pairs at a time."""
    return np.concatenate([np.empty(0), *[(unit[a[i : i + most]] * unit[b[i : i + most]]).sum(axis=1) for i in range(0, len(a), most)]])


def _recompute(bits: int, bands_by_dim: dict, threshold: float, seed: int):
    coders: dict[int, BinaryCodes] = {}

    def run(table: pa.Table) -> pa.Table:
        """Exact cosines of the pairs that the bounds leave, and of no others: each row's links and the smallest class they reach."""
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        a, b = _met_pairs(table, bits, bands_by_dim, threshold, seed, coders)
        near = cosines(unit_rows(table.column("vec").to_pylist()), a, b) >= threshold
        a, b = a[near], b[near]
        links, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while len(a) and (root[a] != root[b]).any():
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        linked = links > 0
        return pa.table({"id": ids[linked], "links": links[linked], "root": root[linked]})

    return run


def links(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, bits: int = 256, chunk: int = 512, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)``, a row for every row of ``vectors``.

    Equal vectors are one class, numbered by the vector and not by a row's id, and are compared once; their rows
    are links of each other, as are rows of one id only where their vectors are. Every row is in the index; a
    pair at the threshold is a candidate with probability ``recall`` (pairs above it more often), and each link
    holds exactly: cosine in double precision of at least ``threshold``, ties included. Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing, nor do those of another dimension. A
    row of a null id links with nothing. An empty table gives no rows; other columns play no part.
    """
    vec = F.col(vec_col).cast("array<double>")
    marked = vectors.select(F.col(id_col).cast("long").alias("_id"), F.when(usable(F.col(vec_col)) & F.col(id_col).isNotNull(), vec).alias("vec"))
    grouped = marked.where("vec is not null").groupBy("vec").agg(F.min("_id").alias("least"), F.count("*").alias("copies"))
    classes = checkpoint(grouped.withColumn("id", F.monotonically_increasing_id()))  # numbers last as long as the written table
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("vec")).count().collect()}  # a row for each dimension
    bands = {d: plan_bands(n, threshold, recall, BinaryCodes.padded(d, bits)) for d, n in sizes.items()}
    coded = checkpoint(classes.select("id", "vec").mapInArrow(_encode(bits, bands, seed), "id long, dim int, code binary, factor double, small binary, lost double, bands array<long>"))
    # only rows that share a key with somebody carry their codes into a cell
    keyed = coded.select("id", "dim", F.posexplode("bands").alias("tree", "key")).select("id", (F.col("tree") + F.col("dim") * _TREES).cast("int").alias("tree"), "key")
    cells = bundled(to_cells(keyed, chunk), max(sizes.values(), default=0)).join(coded.drop("bands"), "id")
    met = checkpoint(cells.groupBy("tree", "bundle").applyInArrow(_survivors(bits, bands, threshold, seed), "tree int, key long, lo int, hi int, bundle long, id long, part int"))
    loaded = met.join(coded.drop("bands"), "id").join(classes.select("id", "vec", "copies"), "id")
    found = checkpoint(loaded.groupBy("tree", "bundle").applyInArrow(_recompute(bits, bands, threshold, seed), "id long, links long, root long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("root"))
    heads = parts.join(classes.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("head"))
    by_class = (
        classes.join(linked, "id", "left").join(parts.join(heads, "root").select("id", "head"), "id", "left")
        .select(F.col("vec").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "least").alias("component_id"))
    )
    joined = marked.where("vec is not null").join(by_class, F.col("vec") == F.col("_v")).select("_id", "n_links", "component_id")
    alone = marked.where("vec is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    every = joined.unionByName(alone)
    return every.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))
