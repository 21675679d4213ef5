"""Which positions of a token sequence may look at which others, as arrays in the sequence's own row.

A sequence is one row with arrays of equal length (see ``layout.features``); its mask is an array of arrays.
Nothing is joined or moved, and work grows with the square of the bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _grid(size: Column, allowed) -> Column:
    """``size`` by ``size`` of 0 and 1; ``allowed(i, j)`` gets positions from 0. Empty for empty sequences."""
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.transform(places, lambda j: F.coalesce(allowed(i, j), F.lit(False)).cast("int")))


def _question_or_same(segments: Column, *kinds: Column):
    def run(i: Column, j: Column) -> Column:
        out = (F.get(segments, i) == 0) | (F.get(segments, j) == 0)
        for k in kinds:
            out = out | (F.get(k, i) == F.get(k, j))
        return out

    return run


def sparse_mask(segments: Column, columns: Column, rows: Column, valid: Column) -> Column:
    """Position i sees j if j is valid and they share a column or a row or either belongs to the question (segment 0)."""
    met = _question_or_same(segments, columns, rows)
    return _grid(F.size(segments), lambda i, j: (F.get(valid, j) == 1) & met(i, j))


def bucket_ids(kind: Column, valid: Column, bucket: int, header: int) -> Column:
    """Bucket of each position when positions are sorted by ``kind``, invalid ones last: ``header`` of them in bucket 0, then ``bucket`` each."""
    keyed = F.transform(kind, lambda k, i: F.struct(F.when(F.get(valid, i) == 1, 0).otherwise(1).alias("last"), k.alias("k"), i.alias("i")))
    order = F.transform(F.sort_array(keyed), lambda x: x["i"])
    place = lambda i: F.array_position(order, i) - 1
    return F.transform(kind, lambda _, i: F.greatest(F.floor((place(i) - header) / F.lit(bucket)) + 1, F.lit(0)).cast("int"))


def headwise_mask(segments: Column, kind: Column, valid: Column, buckets: Column | None = None, bucket: int = 0) -> Column:
    """Mask of the heads that look along ``kind`` (rows or columns).

    With ``buckets`` (of :func:`bucket_ids`) positions also have to lie in the same or neighbouring buckets, in
    bucket 0, or in the second and the last bucket, which count as neighbours.
    """
    met, size = _question_or_same(segments, kind), F.size(segments)

    def allowed(i: Column, j: Column) -> Column:
        out = (F.get(valid, j) == 1) & met(i, j)
        if buckets is None:
            return out
        a, b = F.get(buckets, i), F.get(buckets, j)
        gap = F.abs(a - b)
        return out & ((gap <= 1) | (gap == F.floor(size / F.lit(bucket)) - 2) | (a == 0) | (b == 0))

    return _grid(size, allowed)
