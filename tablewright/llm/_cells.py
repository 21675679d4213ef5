"""Comparing rows that share a key, without one task for a hot key and without pairs as rows.

Rows ``(tree, key, id, ...)`` are gathered into cells. A key of at most ``chunk`` rows is one cell. The
rows of a larger key are dealt into parts of about ``chunk`` rows, and every two parts (and every part
with itself) meet in a cell of their own, so each pair of rows meets once and no cell is unbounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("tree", "key", "lo", "hi")


def to_cells(rows: DataFrame, chunk: int = 512) -> DataFrame:
    """Adds ``part, lo, hi``; rows whose key nobody shares are left out."""
    counts = rows.groupBy("tree", "key").agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(chunk)).cast("int")
    met = rows.join(counts, ["tree", "key"]).withColumn("_k", parts)
    met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return met.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_k", "_n", "_other")


def bundled(cells: DataFrame, rows: int, size: int = 2048) -> DataFrame:
    """Adds ``bundle``: cells of one tree that a task may take in one call, about ``size`` rows of them.

    ``rows`` is a tree's number of rows. The first cells of all keys hold each row once at most, so they share
    the bundles; each further cell of a large key is a bundle of its own.
    """
    shared = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // size))))
    return cells.withColumn("bundle", F.when(F.col("hi") == 0, shared).otherwise(F.xxhash64("key", "lo", "hi")))


def pair_mask(part: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which of the pairs (i, j) belong to the cell; symmetric, without the diagonal."""
    if lo == hi:
        out = np.ones((len(part), len(part)), dtype=bool)
    else:
        out = part[:, None] != part[None, :]
    np.fill_diagonal(out, False)
    return out


def first_shared(bands: np.ndarray, tree: int, mask: np.ndarray) -> np.ndarray:
    """Keeps of ``mask`` the pairs that share no key of an earlier tree, so a pair is met in one tree only."""
    for t in range(tree):
        if not mask.any():
            break
        mask &= bands[:, None, t] != bands[None, :, t]
    return mask


def roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches by links inside the cell."""
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(link, label[None, :], np.iinfo(label.dtype).max).min(axis=1, initial=np.iinfo(label.dtype).max))
        if (new == label).all():
            return label
        label = new
