"""Mixing sources to target weights, with DataFrame functions only.

Targets come from capped water-filling in closed form: with sources in the order of cap / weight, the first
``j`` are at their caps and the rest share what is left by weight, for the first ``j`` at which the next
source stays below its cap. A source's target is then taken as whole repetitions of all its documents and
one fractional repetition: documents in a seeded order until the rest of the target is used up, the last one
in part. The order is cut at hash buckets whose sums are aggregated first, so only documents of one bucket
a source are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import checkpoint
from ._words import WORD_PATTERN

BUCKETS = 4096
#: Sources up to which the plan, a row of 60 bytes or so for each, is broadcast; beyond, a salted join.
BROADCAST_SOURCES = 10_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size long, weight)`` -> the same with ``target`` (double).

    Sources share the sum of all sizes by weight; no target exceeds ``max_epochs`` times its source's size.
    The table has one row for each source, so its two ordered windows are small. A source of size 0 gets 0.
    """
    one = sizes.withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("weight").over(everything))
    one = one.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(order), F.lit(0))).withColumn("_share", F.col("_weights") - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    # the first source whose share stays within its cap fixes the level for itself and all that follow
    fits = F.col("_cap") * F.col("_share") >= F.col("_left") * F.col("weight")
    level = F.min(F.when(fits, F.struct((F.col("_cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("_left").alias("left"), F.col("_share").alias("share")))).over(everything)
    one = one.withColumn("_at", level)
    share = F.col("_at.left").cast("double") * F.col("weight").cast("double") / F.col("_at.share").cast("double")
    capped = F.col("_at").isNull() | (F.col("_cap") * F.col("_at.share") < F.col("_at.left") * F.col("weight"))
    return one.select("source", "source_size", "weight", F.when(capped, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def cycled_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, 1, ... by the sources' code point order, null last."""
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), ((at - 1) % len(cycle) + 1).cast("int")).cast("long"))


def ticket(id_col: Column, seed: int) -> Column:
    """A seeded number of 60 bits for a document: the head of an MD5, equal in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, size, source_size, target, taken)`` and the ``carry`` columns, a row for every row of ``docs``.

    ``weights`` maps a ``(source, source_size)`` table to one with ``weight`` (a positive long). ``taken``
    counts words, whole and fractional repetitions together; it is at most ``max_epochs * size``, and each
    source's sum is its target rounded down. Empty documents take 0. Null sources are a source of their own,
    a null id has a ticket of its own; rows of one id share their ticket and follow each other by size.
    """
    late = "_text"
    base = docs.select(F.col(id_col), F.col(source_col).alias("_source"), F.col(text_col).alias(late), *[F.col(c).alias(f"_carry_{c}") for c in carry], ticket(F.col(id_col), seed).alias("_ticket"))
    base = base.withColumn("_bucket", F.expr(f"int(_ticket div {(1 << 60) // BUCKETS})"))
    # a row for each source and bucket, however many documents there are
    sums = checkpoint(base.groupBy("_source", "_bucket").agg(F.sum(word_count(F.col(late))).alias("n")))
    sizes = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("source_size"))
    goal = targets(weights(sizes), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    # where in the buckets of a source the rest ends, and how much of it that bucket gets
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("n")
    cut = (
        sums.withColumn("before", before)
        .join(goal.select(F.col("source").alias("_s"), "rest"), F.col("_source").eqNullSafe(F.col("_s")))
        .where("before < rest and before + n >= rest")
        .select("_s", F.col("_bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("in_cut"))
    )
    plan = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c._s")), "left")
    plan = checkpoint(plan.select(F.col("g.source").alias("_p"), "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("in_cut", F.lit(0)).cast("long").alias("in_cut")))
    if plan.count() <= BROADCAST_SOURCES:
        joined = base.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_p")))
        size = word_count(F.col(late))
    else:
        # a hot source is dealt to SALTS keys; texts stay behind, only their sizes move
        base = base.withColumn("size", word_count(F.col(late))).drop(late)
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.join(salted, F.col("_source").eqNullSafe(F.col("_p")) & (F.col("_bucket") % SALTS == F.col("_salt")))
        size = F.col("size")
    out = [F.col(id_col), F.col("size"), F.col("source_size"), F.col("target")]
    kept = [F.col(f"_carry_{c}").alias(c) for c in carry]
    taken = F.col("whole") * F.col("size")
    clear = joined.where("_bucket <> cut").withColumn("size", size).select(*out, (taken + F.when(F.col("_bucket") < F.col("cut"), F.col("size")).otherwise(0)).cast("long").alias("taken"), *kept)
    # only the cut buckets, about one document in BUCKETS, are sorted
    turn = Window.partitionBy("_source").orderBy("_ticket", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("in_cut") - F.coalesce(F.sum("size").over(turn), F.lit(0))))
    edge = joined.where("_bucket = cut").withColumn("size", size).withColumn("_part", part).select(*out, (taken + F.col("_part")).cast("long").alias("taken"), *kept)
    return clear.unionByName(edge)
