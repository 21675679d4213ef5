"""N-gram Jaccard self-join: a MinHash LSH forest and exact verification.

Each document's set of word ``n``-grams gets a signature of ``trees`` strings of ``depth`` MinHash values. A tree
is the trie of its strings, kept as sorted runs: equal neighbours share a node, and the common prefix of two rows
is the depth of the last node that they share. Two documents are matched at the longest prefix that they have in
common in any tree. Matching starts at whole strings and shortens the prefix, level by level, until the recall
that is reached meets the target. How much each shorter prefix adds is counted on the tries themselves: pairs by
level and by how many of all their MinHash values agree, of which those near the threshold or above count. No
prefix gets shorter than ``floor_for``, at which the modelled recall of a pair right at the threshold meets the
target whatever the data; tries are therefore cut into the subtries below that prefix, which meet in cells of
bounded size (see ``_cells``), each pair in the first tree that joins it.

Documents of one n-gram set are one class, numbered by that set (not by a document's id), and enter the forest
once. Only classes with a partner at the chosen prefix bring their texts, and every such pair is verified by the
exact Jaccard similarity of their sets of 64-bit gram hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._cells import bundled, to_cells
from ._components import components
from ._store import checkpoint
from ._words import WordHashes, as_utf8, split_words, window_hashes

#: Columns of the incidence matrix that are multiplied at once.
_WIDE = 4096
#: Pairs whose levels are looked up at once.
_PAIRS = 1 << 17
#: Ids (8 bytes each) that may be broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A signature value has as many bits; equal upper bits of unequal minima only add candidates.
VALUE = np.dtype("<u2")


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; a text of fewer words is one gram of all its words; an empty one has none."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(words, min(n, len(words))) + np.uint64(0 if len(words) >= n else len(words)))


def print_of(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def modelled_recall(similarity: float, trees: int, prefix: int) -> float:
    return 1 - (1 - similarity**prefix) ** trees


def floor_for(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that still finds a pair at ``threshold`` with probability ``recall`` in some tree."""
    for r in range(depth, 0, -1):
        if modelled_recall(threshold, trees, r) >= recall:
            return r
    raise ValueError("too few trees for this recall, even with prefixes of one value")


def choose_prefix(seen: dict[tuple[int, int], int], values: int, threshold: float, trees: int, floor: int, depth: int, recall: float) -> int:
    """Shortens the prefix from ``depth`` until the pairs matched so far reach ``recall``, at ``floor`` at the latest.

    ``seen`` maps (level, agreeing values) to a number of pairs. Pairs count whose agreement is no more than two
    standard errors below the threshold; what even the floor misses of them is taken from the model.
    """
    least = (threshold - 2 * math.sqrt(threshold * (1 - threshold) / values)) * values
    likely = [sum(n for (level, agree), n in seen.items() if level == l and agree >= least) for l in range(depth + 1)]
    everything = sum(likely[floor:]) / modelled_recall(threshold, trees, floor)
    for prefix in range(depth, floor, -1):
        if sum(likely[prefix:]) >= recall * everything:
            return prefix
    return floor


def minhashes(grams: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each of the functions ``odd * x + add`` its minimum over the set, upper bits."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(grams), 256):
        np.minimum(low, (grams[a : a + 256, None] * odd[None, :] + add[None, :]).min(axis=0), out=low)
    return (low >> np.uint64(64 - 8 * VALUE.itemsize)).astype(VALUE)


def trie(strings: np.ndarray) -> np.ndarray:
    """The sorted trie of a tree's strings: for each row the number of its node at every level from 1 on."""
    order = np.lexsort(strings.T[::-1])
    parted = np.zeros(strings.shape, dtype=bool)  # whether the common prefix with the row before ends above this level
    parted[1:] = np.logical_or.accumulate(strings[order][1:] != strings[order][:-1], axis=1)
    nodes = np.empty(strings.shape, dtype=np.int32)
    nodes[order] = np.cumsum(parted, axis=0)
    return nodes


def cell_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs that meet in a cell of this bundle, each once, a bounded number at a time."""
    key, lo, hi, part = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "part"))
    order = np.lexsort((hi, lo, key))
    same = lambda x: x[order][1:] == x[order][:-1]
    first = np.concatenate([[0], np.flatnonzero(~(same(key) & same(lo) & same(hi))) + 1, [len(order)]])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(order))  # rows from here to the cell's end
    step, i = 1, np.flatnonzero(left > 1)
    held, size = [], 0
    while len(i):
        a, b = order[i], order[i + step]
        meet = (lo[a] == hi[a]) | (part[a] != part[b])
        held.append((a[meet], b[meet]))
        size += len(a)
        step += 1
        i = i[left[i] > step]
        if size >= _PAIRS or not len(i):
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0


class Forest:
    """The subtries of one bundle: all trees' nodes of its rows."""

    def __init__(self, signatures: list[bytes], trees: int, depth: int):
        self.values = np.array([np.frombuffer(s, dtype=VALUE) for s in signatures]).reshape(-1, trees, depth)
        self.nodes = [trie(self.values[:, t]) for t in range(trees)]

    def levels(self, a: np.ndarray, b: np.ndarray, tree: int, floor: int) -> np.ndarray:
        """The longest prefix of each pair in any tree; 0 for pairs that an earlier tree joins at the floor already."""
        best, before = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=bool)
        for t, nodes in enumerate(self.nodes):
            common = (nodes[a] == nodes[b]).sum(axis=1)  # nodes below a split differ
            before |= (t < tree) & (common >= floor)
            best = np.maximum(best, common)
        return np.where(before, 0, best)

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.values[a] == self.values[b]).sum(axis=(1, 2))


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of hashes, by products of incidence matrices in bounded strips."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    keys, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    common = count[inverse] > 1
    column, owner = rank[inverse[common]], owner[common]
    out = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, top, _WIDE):
        s = slice(*np.searchsorted(column, [a, a + _WIDE]))
        strip = np.zeros((m, min(_WIDE, top - a)), dtype=np.float32)
        strip[owner[s], column[s] - a] = 1
        out += strip @ strip.T
    return out


def _signatures(n: int, trees: int, depth: int, seed: int):
    def run(batches):
        turn = np.random.default_rng(seed)
        odd = turn.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = turn.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
        hashes = WordHashes()
        for b in batches:
            grams = [shingles(hashes.of(split_words(t)), n) for t in b.column("_text").to_pylist()]
            signed = [minhashes(g, odd, add).tobytes() if len(g) else None for g in grams]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(map(print_of, grams), pa.binary()), pa.array(signed, pa.binary())], names=["_id", "print", "sig"])

    return run


#: Rows of a bundle with their best level; a row of number -1 counts pairs: ``key`` of level ``best``, of which ``part`` values agree.
_MET = "tree int, key long, lo int, hi int, bundle long, id long, part int, best int"


def _descend(trees: int, depth: int, floor: int):
    def run(table: pa.Table) -> pa.Table:
        tree, forest = table.column("tree")[0].as_py(), Forest(table.column("sig").to_pylist(), trees, depth)
        best, seen = np.zeros(table.num_rows, dtype=np.int32), np.zeros((depth + 1, trees * depth + 1), dtype=np.int64)
        for a, b in cell_pairs(table):
            level = forest.levels(a, b, tree, floor)
            a, b, level = a[level >= floor], b[level >= floor], level[level >= floor]
            np.maximum.at(best, a, level.astype(np.int32))
            np.maximum.at(best, b, level.astype(np.int32))
            np.add.at(seen, (level, forest.agreement(a, b)), 1)
        names = [c.split()[0] for c in _MET.split(", ")]
        rows = table.append_column("best", pa.array(best)).filter(pa.array(best > 0)).select(names)
        level, agree = np.nonzero(seen)
        zero = np.zeros(len(level), dtype=np.int32)
        counts = dict(tree=zero, key=seen[level, agree], lo=zero, hi=zero, bundle=zero.astype(np.int64), id=zero.astype(np.int64) - 1, part=agree.astype(np.int32), best=level.astype(np.int32))
        return pa.concat_tables([rows, pa.table({c: pa.array(counts[c], rows.schema.field(c).type) for c in names})])

    return run


def _verify(n: int, threshold: float, trees: int, depth: int, floor: int, prefix: int):
    def run(table: pa.Table) -> pa.Table:
        """Of each class with links in this bundle: how many rows it is linked to, and the least class that they reach."""
        hashes = WordHashes()
        sets = [shingles(hashes.of(split_words(t)), n) for t in table.column("_text").to_pylist()]
        right = [print_of(s) == p for s, p in zip(sets, table.column("print").to_pylist())]  # else another text of the same id
        table, sets = table.filter(pa.array(right)), [s for s, r in zip(sets, right) if r]
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        links, root, size = np.zeros(len(ids), dtype=np.int64), ids.copy(), np.array([len(s) for s in sets], dtype=np.int64)
        if len(ids) > 1:
            tree, forest = table.column("tree")[0].as_py(), Forest(table.column("sig").to_pylist(), trees, depth)
            linked = []
            for a, b in cell_pairs(table):
                level = forest.levels(a, b, tree, floor)
                a, b = a[level >= prefix], b[level >= prefix]
                both = _intersections(sets, a, b)
                # of whole numbers: both / (a + b - both) >= threshold, without a rounded quotient
                near = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                linked.append((a, b))
            a, b = (np.concatenate(x) for x in zip(*linked)) if linked else (np.empty(0, dtype=np.int64),) * 2
            while len(a) and (root[a] != root[b]).any():
                least = np.minimum(root[a], root[b])
                np.minimum.at(root, a, least)
                np.minimum.at(root, b, least)
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": root[some]})

    return run


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the common sets of pairs: one by one if they are few, else by products over the rows they touch."""
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < 4 * len(rows):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], dtype=np.int64)
    return overlap([sets[r] for r in rows.tolist()])[place[: len(a)], place[len(a) :]].astype(np.int64)


def _picked(ids: DataFrame) -> DataFrame:
    """A table of ids with a broadcast hint if it is of a proven size."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _resolve(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, trees: int = 16, depth: int = 8, chunk: int = 512, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(every row's ``_id, print``, every class's ``_p, class_id, n_links, component_id, first``).

    ``first`` marks the class that stands for its component: the one of the smallest id, then of the least print.
    """
    floor = floor_for(threshold, trees, depth, recall)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), as_utf8(text_col).alias("_text"))
    signed = checkpoint(base.mapInArrow(_signatures(n, trees, depth, seed), "_id long, print binary, sig binary"))
    usable = signed.where("_id is not null and print is not null")
    grouped = usable.groupBy("print").agg(F.min("_id").alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = checkpoint(grouped.withColumn("id", F.monotonically_increasing_id()))  # numbers last as long as the written table
    size = depth * VALUE.itemsize
    strings = classes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = strings.select("id", "tree", F.xxhash64(F.expr(f"substring(sig, tree * {size} + 1, {floor * VALUE.itemsize})")).alias("key"))
    cells = bundled(to_cells(rows, chunk), classes.count()).join(classes.select("id", "sig"), "id")
    met = checkpoint(cells.groupBy("tree", "bundle").applyInArrow(_descend(trees, depth, floor), _MET))
    seen = {(r[0], r[1]): r[2] for r in met.where("id < 0").groupBy("best", "part").agg(F.sum("key")).collect()}  # at most depth x values
    prefix = choose_prefix(seen, trees * depth, threshold, trees, floor, depth, recall)
    matched = met.where(F.col("id") >= 0).where(F.col("best") >= prefix).drop("best")
    wanted = matched.select("id").distinct().join(classes.select("id", "print", "least", "copies", "sig"), "id")
    some = _picked(wanted.select(F.col("least").alias("_id")).distinct())
    # an id's texts are dealt out by the id; of equal ones one stays, of different ones the class finds its own by the print
    texts = base.where("_id is not null").join(some, "_id", "left_semi").withColumn("_same", F.xxhash64("_text")).repartition("_id").dropDuplicates(["_id", "_same"])
    loaded = matched.join(wanted, "id").join(texts.select(F.col("_id").alias("least"), "_text"), "least")
    found = checkpoint(loaded.groupBy("tree", "bundle").applyInArrow(_verify(n, threshold, trees, depth, floor, prefix), "id long, links long, root long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("root"))
    every = classes.select("print", "id", "least", "copies").join(linked, "id", "left").join(parts, "id", "left")
    heads = parts.join(classes.select("id", "least", "print"), "id").groupBy("root").agg(F.min(F.struct("least", "print")).alias("head"))
    by_class = every.join(heads, "root", "left").select(
        F.col("print").alias("_p"), F.col("least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("head.least", "least").alias("component_id"), F.coalesce(F.col("head.print") == F.col("print"), F.lit(True)).alias("first"),
    )
    return signed.select("_id", "print"), by_class


def links(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``(id, class_id, n_links, component_id, kept)``, a row for every row of ``docs``.

    ``class_id`` is the smallest id with the same set of word n-grams; ``n_links`` counts the other rows that
    are linked, copies included; ``component_id`` is the smallest id reachable by links. Links are found with
    probability ``recall`` or more at the threshold (more above it) and hold exactly: none is below it. Texts
    without words link with nothing; texts of fewer than ``n`` words link with those of the same words. A row
    of a null id links with nothing. Rows of one id are compared like any others: they are copies of each other
    only where their texts are. Similarities right at the threshold are links; an empty table gives no rows;
    other columns of ``docs``, of any name, play no part. See :func:`_resolve` for the parameters.
    """
    signed, by_class = _resolve(docs, id_col=id_col, **how)
    usable = signed.where("_id is not null and print is not null")
    joined = usable.join(by_class, F.col("print") == F.col("_p")).select("_id", "class_id", "n_links", "component_id")
    alone = signed.where("_id is null or print is null").select("_id", F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    every = joined.unionByName(alone)
    return every.select(F.col("_id").alias(id_col), "class_id", "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one: that of its smallest id, then of the least print.

    All columns stay as they were. Of repeated rows of one id and n-gram set the least stays, by all columns in
    order, so reruns agree. Rows of a null id and texts without words all stay. An empty table gives no rows.
    """
    signed, by_class = _resolve(docs, id_col=id_col, text_col=text_col, **how)
    usable = signed.where("_id is not null and print is not null")
    kept = by_class.where("first").select(F.col("class_id").alias("_kid"), F.col("_p").alias("_kp"))
    repeated = checkpoint(signed.where("_id is not null").groupBy("_id").count().where("count > 1").select(F.col("_id").alias("_again")))
    gone = checkpoint(usable.join(kept, (F.col("_id") == F.col("_kid")) & (F.col("print") == F.col("_kp")), "left_anti").select(F.col("_id").alias("_gone")).distinct())
    key = F.col(id_col).cast("long")
    if repeated.isEmpty():
        return docs.join(_picked(gone), key == F.col("_gone"), "left_anti")
    once = docs.join(_picked(gone.unionByName(repeated.withColumnRenamed("_again", "_gone")).distinct()), key == F.col("_gone"), "left_anti")
    some = docs.join(_picked(repeated), key == F.col("_again"), "left_semi")
    marked = some.select(key.alias("_kid"), F.struct("*").alias("_row"), as_utf8(text_col).alias("_text")).mapInArrow(_printed(how.get("n", 5)), StructType([*some.select(key.alias("_kid"), F.struct("*").alias("_row")).schema.fields, StructField("_kp", BinaryType())]))
    best = marked.join(kept, ["_kid", "_kp"], "left_semi").groupBy("_kid", "_kp").agg(F.min("_row").alias("_row")).select("_row.*")
    return once.unionByName(best).unionByName(marked.where("_kp is null").select("_row.*"))


def _printed(n: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            prints = [print_of(shingles(hashes.of(split_words(t)), n)) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_kid"), b.column("_row"), pa.array(prints, pa.binary())], names=["_kid", "_row", "_kp"])

    return run
