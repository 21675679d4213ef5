"""Importance resampling towards a target distribution of hashed word n-grams.

A scan of a text keeps a ring of running CRC-32 states, one for each of the last ``n`` starts: the next word extends
each by a space and itself, and every state on the way is the checksum of one n-gram, so no n-gram is ever put together
as a string. Corpus and target texts are counted by bucket (first scan), a bucket's gain is the logarithm of the ratio
of its smoothed shares, and a document's weight is the mean gain of its features (second scan). Seeded Gumbel noise on
the weights makes the highest scores a draw without replacement in proportion to the exponential of the weights.

What moves between tasks: bucket counts, at most ``buckets`` rows a task; then ids with numbers, never texts. The
drawn rows are numbered without one sorted task: from counts by score and id range, and a sort inside each of these.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import checkpoint
from ._words import as_utf8

#: A-Z to a-z; the bytes of every character outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Scores of one step of the first counts, and id ranges into which the documents of one score are cut.
STEP, RANGES = 256, 64


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def checksums(words: list[bytes], n: int) -> list[int]:
    """CRC-32 of every run of 1 to ``n`` consecutive words joined by one space, repeats included."""
    ring, out, crc = [], [], zlib.crc32
    for word in words:
        spaced = b" " + word
        ring = [crc(spaced, state) for state in ring]  # the last n - 1 starts, each one word longer
        ring.append(crc(word))
        out += ring
        if len(ring) == n:
            del ring[0]
    return out


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 2, buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into each bucket that has any.

    Counted inside each task first, so at most ``buckets`` rows leave one. Null and empty texts have no features.
    """

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                at = np.array(checksums(words_of(text), n), dtype=np.int64)
                if len(at):
                    total += np.bincount(at % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    part = texts.select(as_utf8(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Each bucket's ``floor(1000 * ln(share in target / share in corpus))``, both smoothed by one, from two ``bucket_counts``.

    The table has ``buckets`` rows whatever the corpus, so it comes to the driver.
    """
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    seen = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_ = seen.sparkSession.range(buckets).join(seen, F.col("id") == F.col("bucket"), "left").select("id", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    whole = all_.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = all_.crossJoin(F.broadcast(whole)).select("id", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()  # a cross join with one row
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 2) -> DataFrame:
    """``(id, n_words, n_features, weight)``: the floored mean of the gains of a text's features, 0 without any."""
    fields = docs.select(F.col(id_col).alias("_id")).schema

    def run(batches):
        for b in batches:
            words, features, weights = [], [], []
            for text in b.column("_text").to_pylist():
                mine = words_of(text)
                at = np.array(checksums(mine, n), dtype=np.int64) % len(gain)
                words.append(len(mine))
                features.append(len(at))
                weights.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([b.column("_id"), *[pa.array(x, pa.int64()) for x in (words, features, weights)]], names=["_id", "n_words", "n_features", "weight"])

    for name in ("n_words", "n_features", "weight"):
        fields = fields.add(name, "long")
    return docs.select(F.col(id_col).alias("_id"), as_utf8(text_col).alias("_text")).mapInArrow(run, fields).withColumnRenamed("_id", id_col)


def noise(id_col: Column, seed: int) -> Column:
    """Seeded Gumbel noise of an id, in thousandths, rounded down; a null id is the word ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int, id_col: str = "doc_id", eligible: str = "eligible") -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the ``percent`` of the eligible rows of the highest ``score``, else null.

    Ties go to the smaller id, a null id before all; repeated rows of one id are rows each, in the order of their other
    columns. Counts by steps of scores, scores and id ranges give the first rank of each cell; only the rows of
    cells that reach into the draw are sorted, each cell by itself. ``scored`` is read several times: pass a
    checkpoint or a table.
    """
    may = F.coalesce(F.col(eligible), F.lit(False))
    low, high, total = scored.where(may).agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    wanted = percent * total // 100
    place = (F.col(id_col).cast("double") - F.lit(float(low or 0))) / F.lit(float(high or 0) - float(low or 0) + 1.0) * RANGES
    ranged = scored.withColumn("_range", F.when(F.col(id_col).isNull(), -1).otherwise(F.least(F.floor(place), F.lit(RANGES - 1))).cast("int"))
    cells = ranged.where(may).groupBy("score", "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_step", F.floor(F.col("score") / STEP))
    steps = cells.groupBy(F.col("_step").alias("_s")).agg(F.sum("_n").alias("_rows"))
    # one row for each step of scores: some hundreds, as scores are bounded by the logarithm of a count
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_above", F.coalesce(F.sum("_rows").over(above), F.lit(0))).where(F.col("_above") < wanted)
    inside = Window.partitionBy("_step").orderBy(F.col("score").desc(), "_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(steps, F.col("_step") == F.col("_s"))
    cells = checkpoint(cells.select("score", "_range", (F.col("_above") + F.col("_inside")).alias("_before")).where(F.col("_before") < wanted))
    last = cells.agg(F.min_by(F.struct("score", "_range"), F.struct(F.col("score"), -F.col("_range")))).first()[0]
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reaches = may & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (F.col("_range") <= last["_range"])))
    others = [c for c in scored.columns if c != id_col]
    order = Window.partitionBy("score", "_range").orderBy(F.col(id_col).asc_nulls_first(), *others)
    rank = F.col("_before") + F.row_number().over(order)
    taken = ranged.where(reaches).join(cells, ["score", "_range"]).withColumn("rank", F.when(rank <= wanted, rank).cast("long"))
    left = ranged.where(~reaches).withColumn("rank", F.lit(None).cast("long"))
    return taken.select(*scored.columns, "rank").unionByName(left.select(*scored.columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7
) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)``, a row for every row of ``docs``.

    Null and empty texts have no features and weight 0; texts below ``min_words`` are weighed but never drawn. An empty
    corpus gives no rows, an empty target the smoothed gains. Rows of one id share their noise and are rows each.
    Other columns, of any name, play no part.
    """
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_text, n, buckets), buckets)
    weighed = weigh(docs, gain, id_col, text_col, n)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).withColumn("eligible", F.col("n_words") >= min_words)
    return draw(checkpoint(scored), percent, id_col).select(id_col, "n_words", "n_features", "weight", "score", "rank")
