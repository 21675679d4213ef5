"""End-to-end evaluation: retrieved tables, the answers read from them, and what the best reader could have got.

Candidates belong to examples, predictions to candidates, references to examples. Each answer meets each reference of its
example once; the rest is aggregation: the best reference of an answer, the best answer of an example, the means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def tokens(answer: Column) -> Column:
    """Words of an answer in lower case, without punctuation and articles."""
    return F.filter(F.split(text.answer_normalize(answer), " "), lambda t: t != "")


def token_scores(gold: Column, pred: Column) -> Column:
    """``struct<f1, exact, precision, recall>`` of two token arrays; against no tokens precision (recall) is 1, without a common one all are 0."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    both = F.aggregate(F.array_distinct(gold), F.lit(0), lambda s, t: s + F.least(count(gold, t), count(pred, t))).cast("double")
    p, r = F.when(F.size(pred) > 0, both / F.size(pred)).otherwise(1.0), F.when(F.size(gold) > 0, both / F.size(gold)).otherwise(1.0)
    some = p + r >= 1e-5
    zero = F.lit(0.0)
    return F.struct(F.when(some, 2 * p * r / (p + r)).otherwise(zero).alias("f1"), (gold == pred).cast("double").alias("exact"), F.when(some, p).otherwise(zero).alias("precision"), F.when(some, r).otherwise(zero).alias("recall"))


def references(candidates: DataFrame) -> DataFrame:
    """``(example_id, reference)``: the different answers of an example's candidates, each the sorted texts of one alternative."""
    one = candidates.select("example_id", F.explode("answers").alias("a"))
    joined = F.array_join(F.array_sort(F.filter("a", lambda t: t.isNotNull() & (t != ""))), " ")
    return one.select("example_id", joined.alias("reference")).where("reference <> ''").distinct()


def examples(candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row for each example: what its best candidate got, and the best that any got.

    ``candidates``: ``example_id, candidate_id, place, is_gold_table, answers array<array<string>>`` (alternatives, each
    of one or more texts); ``predictions``: ``candidate_id, answer, score``; a null answer is none, a null score 0. The
    best candidate has the greatest score, of equals the first by ``place``. An answer counts by its best reference in
    F1, then exactness. Columns: ``referenced, gold, predicted, answered, right_table, best_id``, the four scores and
    ``oracle_f1, oracle_exact``. An example without a prediction is read as an empty answer, one without references
    gets zeros and no table.
    """
    refs = references(candidates)
    said = candidates.join(predictions.where("answer is not null"), "candidate_id").select("example_id", "candidate_id", "place", "is_gold_table", "answer", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    every = candidates.groupBy("example_id").agg(F.bool_or(F.coalesce("is_gold_table", F.lit(False))).alias("gold"))
    # an example's references beside each of its different answers, or beside an empty one; candidates meet what their answer got
    met = refs.join(said.select("example_id", "answer").distinct(), "example_id", "left").withColumn("_read", token_scores(tokens(F.col("reference")), tokens(F.coalesce("answer", F.lit("")))))
    each = met.groupBy("example_id", "answer").agg(F.max("_read").alias("_m")).join(said, ["example_id", "answer"], "left")
    rank = F.struct(F.col("score"), (-F.col("place")).alias("place"), "candidate_id")
    best = each.groupBy("example_id").agg(
        F.max_by(F.struct("candidate_id", "is_gold_table", "answer", "_m"), rank).alias("_b"), F.first("_m").alias("_only"),
        F.max(F.when(F.col("candidate_id").isNotNull(), F.col("_m.f1"))).alias("oracle_f1"), F.max(F.when(F.col("candidate_id").isNotNull(), F.col("_m.exact"))).alias("oracle_exact"),
    )
    chosen = F.coalesce("_b._m", "_only")
    read = best.select(
        "example_id", F.lit(True).alias("referenced"), F.col("_b.candidate_id").alias("best_id"), F.col("_b.candidate_id").isNotNull().alias("predicted"), (F.coalesce("_b.answer", F.lit("")) != "").alias("answered"),
        F.coalesce("_b.is_gold_table", F.lit(False)).alias("right_table"), *[chosen[n].alias(n) for n in ("f1", "exact", "precision", "recall")],
        F.coalesce("oracle_f1", F.lit(0.0)).alias("oracle_f1"), F.coalesce("oracle_exact", F.lit(0.0)).alias("oracle_exact"),
    )
    out = every.join(read, "example_id", "left")
    flags = {n: F.coalesce(n, F.lit(False)) for n in ("referenced", "predicted", "answered", "right_table")}
    zeros = {n: F.coalesce(n, F.lit(0.0)) for n in ("f1", "exact", "precision", "recall")}
    return out.withColumns(flags | zeros | {"gold": F.col("gold") & F.coalesce("referenced", F.lit(False))})


def report(read: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """One row of metrics over the rows of :func:`examples`; the mean of nothing is 1.

    ``splits``: ``example_id, split`` (``table`` or ``passage``: where the answer is); without it the metrics by split are null. An
    example of which nothing was predicted is in no split.
    """
    marked = read
    for name in ("table", "passage"):
        mine = F.lit(False) if splits is None else F.col(f"_{name}").isNotNull() & F.col("predicted")
        if splits is not None:
            marked = marked.join(splits.where(F.col("split") == name).select("example_id").distinct().withColumn(f"_{name}", F.lit(True)), "example_id", "left")
        marked = marked.withColumn(f"in_{name}", mine)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    mean = lambda c, cond=None: F.coalesce(F.avg(c if cond is None else F.when(cond, F.col(c))), F.lit(1.0))
    right = F.count_if("right_table")
    split = lambda c, name: mean(c, F.col(f"in_{name}")) if splits is not None else F.lit(None).cast("double")
    return marked.agg(
        share(right, F.count("*")).alias("table_accuracy"), share(right, F.count_if("predicted")).alias("table_precision"), share(right, F.count_if("gold")).alias("table_recall"),
        mean("exact").alias("answer_accuracy"), split("exact", "table").alias("answer_accuracy_table"), split("exact", "passage").alias("answer_accuracy_passage"),
        share(F.coalesce(F.sum("exact"), F.lit(0.0)), F.count_if("answered")).alias("answer_precision"),
        mean("precision").alias("answer_token_precision"), mean("recall").alias("answer_token_recall"), mean("f1").alias("answer_token_f1"),
        split("f1", "passage").alias("answer_token_f1_passage"), split("f1", "table").alias("answer_token_f1_table"),
        mean("oracle_f1", F.col("referenced")).alias("oracle_answer_token_f1"), mean("oracle_exact", F.col("referenced")).alias("oracle_answer_accuracy"),
    )
