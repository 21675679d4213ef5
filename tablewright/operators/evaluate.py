"""Denotations and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def denotation(cells: DataFrame, question: str, text: str, agg: Column) -> DataFrame:
    """``(question, agg, values)``: sorted values of the aggregation over a question's cells.

    COUNT counts; SUM and AVERAGE of texts that are not all numbers fall back to the values; of no cells to
    none. Cells with a null text stand for questions without cells.
    """
    value = numbers.to_float(text)
    shown = F.coalesce(F.round(value, 6).cast("string"), F.lower(text))
    marked = cells.withColumn("_agg", agg)
    one = marked.groupBy(question, "_agg").agg(F.count(text).alias("n"), F.count_if(value.isNull() & F.col(text).isNotNull()).alias("bad"), F.sum(value).alias("total"))
    plain = (F.col("_agg") == "NONE") | ((F.col("bad") > 0) & (F.col("_agg") != "COUNT"))
    # values are gathered only where they are the answer
    lists = marked.join(one.where(plain).select(question, "_agg"), [question, "_agg"], "left_semi").groupBy(question, "_agg").agg(F.sort_array(F.collect_list(shown)).alias("plain"))
    single = lambda x: F.array(F.round(x.cast("double"), 6).cast("string"))
    numeric = F.when(F.col("_agg") == "SUM", single(F.col("total"))).when(F.col("_agg") == "AVERAGE", single(F.col("total") / F.col("n")))
    none = F.array().cast("array<string>")
    out = F.when(F.col("_agg") == "COUNT", single(F.col("n"))).when(plain | (F.col("n") == 0), F.coalesce("plain", none)).otherwise(numeric)
    return one.join(lists, [question, "_agg"], "left").select(question, F.col("_agg").alias("aggregation"), out.alias("values"))


def accuracy(df: DataFrame, right: Column, weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1.0)
    return df.agg(F.avg(w * right.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def f1_by_class(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """2TP / (2TP + FP + FN) for each class that occurs on either side, in one pass."""
    sides = df.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("s"), (F.col(gold) == F.col(pred)).alias("hit"))
    return sides.groupBy("s.label").agg((F.sum(F.when(F.col("hit"), F.col("s.g")).otherwise(0)) * 2 / F.sum(F.col("s.g") + F.col("s.p"))).alias("f1"), F.sum("s.g").alias("support"))


def token_f1(gold: Column, pred: Column) -> Column:
    """Multiset overlap F1 of two token arrays; an empty side gives 1.0 against an empty one, else 0."""
    kinds = F.array_distinct(gold)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    both = F.aggregate(kinds, F.lit(0), lambda s, t: s + F.least(count(gold, t), count(pred, t)))
    p, r = both / F.size(pred), both / F.size(gold)
    return F.when((F.size(gold) == 0) & (F.size(pred) == 0), F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def grouped_report(df: DataFrame, group: str, total: str, metrics: dict[str, Column]) -> DataFrame:
    """Metrics for each value of ``group`` and, as ``total``, for all rows: one grouping-sets aggregation."""
    name = F.when(F.grouping(group) == 1, F.lit(total)).otherwise(F.col(group).cast("string"))
    return df.rollup(group).agg(name.alias("name"), *[c.alias(n) for n, c in metrics.items()]).drop(group)


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts by the first edge that the value does not exceed; ``> last`` beyond."""
    bucket = F.lit(f"> {edges[-1]}")
    for e in reversed(edges):
        bucket = F.when(F.col(value) <= e, F.lit(f"<= {e}")).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def end_to_end(preds: DataFrame, table_hit: str, answer_f1: str, exact: str, answered: str) -> DataFrame:
    """Table accuracy, answer accuracy, precision over answered rows, token F1 and the oracle over hit tables; empty sides 1.0."""
    mean = lambda c, cond=None: F.coalesce(F.avg(F.when(cond, c) if cond is not None else c), F.lit(1.0))
    hit, right = F.col(table_hit).cast("double"), F.col(exact).cast("double")
    return preds.agg(
        mean(hit).alias("table_accuracy"), mean(right).alias("answer_accuracy"), mean(right, F.col(answered)).alias("answer_precision"), mean(F.col(answer_f1)).alias("answer_token_f1"), mean(right, F.col(table_hit)).alias("oracle_accuracy")
    )


def join_predictions(examples: DataFrame, preds: DataFrame) -> DataFrame:
    """Examples with ``pred_aggregation`` and ``pred_coordinates``; without a prediction NONE and no cells.

    Both sides have ``question_id``; a prediction of an unknown question is an error, of repeated ones the first in
    the order of their values counts.
    """
    kind = dict(preds.dtypes)["coordinates"]
    one = preds.groupBy("question_id").agg(F.min(F.struct("aggregation", "coordinates")).alias("_p"))
    met = examples.withColumn("_known", F.lit(True)).join(one, "question_id", "full")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("prediction of an unknown question: "), F.col("question_id")))).otherwise(F.col("question_id"))
    chosen = [F.coalesce("_p.aggregation", F.lit("NONE")).alias("pred_aggregation"), F.coalesce("_p.coordinates", F.array().cast(kind)).alias("pred_coordinates")]
    return met.select(known.alias("question_id"), *[c for c in examples.columns if c != "question_id"], *chosen)


def structure(joined: DataFrame) -> DataFrame:
    """One row: ``aggregation_acc, cell_acc, joint_acc, n``; cells are compared as sets."""
    same = F.array_sort(F.array_distinct("coordinates")) == F.array_sort(F.array_distinct("pred_coordinates"))
    right = F.col("aggregation") == F.col("pred_aggregation")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return joined.agg(share(right).alias("aggregation_acc"), share(same).alias("cell_acc"), share(right & same).alias("joint_acc"), F.count("*").alias("n"))


def same_denotation(gold: Column, pred: Column) -> Column:
    """Whether two arrays of values are equal after sorting: numbers as floats of 32 bits, texts in lower case.

    A gold answer that is not a number (NaN) and a prediction of no cells are equal.
    """
    plain = lambda a: F.array_sort(F.transform(a, lambda v: F.coalesce(numbers.to_float(v).cast("float").cast("string"), F.lower(F.trim(v)))))
    nothing = (F.size(gold) == 1) & (F.lower(gold[0]) == "nan") & (F.size(pred) == 0)
    return F.coalesce(nothing | (plain(gold) == plain(pred)), F.lit(False))


def best_cells(tokens: DataFrame, question: str, row: str, column: str, probability: str, place: str) -> DataFrame:
    """``(question, cells)``: each question's cells ``struct<row, column>``, by the mean probability of their tokens, the best first.

    Ties keep the order of the cells' first tokens.
    """
    cells = tokens.groupBy(question, row, column).agg(F.avg(probability).alias("_p"), F.min(place).alias("_at"))
    one = F.struct((-F.col("_p")).alias("p"), F.col("_at").alias("at"), F.struct(F.col(row).alias("row"), F.col(column).alias("column")).alias("cell"))
    return cells.groupBy(question).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["cell"]).alias("cells"))


def answer_type(in_table: Column, in_text: Column) -> Column:
    """The kind of a question's answer by how many of its cells the table itself and linked texts hold."""
    named = [((in_table > 0) & (in_text > 0), "table_&_text"), (in_table == 1, "1_in_table"), (in_text == 1, "1_in_text"), (in_table > 0, "2+_in_table"), (in_text > 0, "2+_in_text")]
    out = F.lit("no_answer")
    for holds, name in reversed(named):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def cell_selection(df: DataFrame, kind: str, gold: str, selected: str, ranked: str | None = None, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Metrics of selected cells, one row for each value of ``kind`` and ``all``; every row of ``df`` is a question.

    ``selected`` is the array of chosen cells, null for a question without a prediction; ``ranked`` all cells, the best
    first. One right cell is enough: ``recall`` is the share of questions with a selected gold cell, ``recall_at_k`` that
    of those with one among the first k. ``precision`` is the mean share of right cells over questions that select any
    (null if none does), ``non_empty`` their share, ``answer_len`` the mean number of selected cells, ``coverage`` the
    share of questions with a prediction.
    """
    chosen = F.array_distinct(F.coalesce(selected, F.slice(gold, 1, 0)))
    hit, n = F.size(F.array_intersect(gold, chosen)), F.size(chosen)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    metrics = {"n": F.count("*"), "recall": share(hit > 0), "precision": F.avg(F.when(n > 0, hit / n)), "non_empty": share(n > 0), "answer_len": F.avg(n.cast("double")), "coverage": share(F.col(selected).isNotNull())}
    if ranked is not None:
        metrics |= {f"recall_at_{k}": share(F.arrays_overlap(F.slice(ranked, 1, k), F.col(gold))) for k in ks}
    return grouped_report(df, kind, "all", metrics)


def majority_label(votes: DataFrame, item: str, label: str, order: str) -> DataFrame:
    """The most frequent label of each item; ties go to the one that was seen first."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return n.groupBy(item).agg(F.max_by(label, F.struct("_n", -F.col("_first"))).alias("label"), F.max("_n").alias("votes"))


def best_step(steps: DataFrame, run: str, metric: str, step: str) -> DataFrame:
    """The step of the best metric of each run, the later one of equals; null metrics do not count."""
    return steps.where(F.col(metric).isNotNull()).groupBy(run).agg(F.max(F.struct(F.col(metric).alias("metric"), F.col(step).alias("step"))).alias("_b")).select(run, "_b.metric", "_b.step")


def feature_headroom(df: DataFrame, experiment: str, features: str, right: str) -> DataFrame:
    """For each feature the greatest loss over experiments: (overall accuracy - the feature's) times its share of rows."""
    whole = df.groupBy(experiment).agg(F.avg(F.col(right).cast("double")).alias("overall"), F.count("*").alias("_all"))
    one = df.select(experiment, F.explode(F.array_distinct(features)).alias("feature"), right).groupBy(experiment, "feature").agg(F.avg(F.col(right).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    met = one.join(whole, experiment).withColumn("headroom", (F.col("overall") - F.col("accuracy")) * F.col("n") / F.col("_all"))
    return met.groupBy("feature").agg(F.max("headroom").alias("headroom"), F.sum("n").alias("n"))


def huber(error: Column, delta: float = 1.0) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * size - 0.5 * delta * delta)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(values: Column) -> Column:
    """Place (from 0) of the first greatest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
