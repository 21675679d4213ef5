"""Preparing interactions for training: filters, answers, duplicates, splits, masked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..schema import INTERACTION, TABLE
from . import synth

#: Answer texts that say nothing, the piece of an empty cell, the task names.
NO_ANSWERS = ("", "-")
EMPTY_PIECE = "[EMPTY]"
MODES = ("NONE", "REMOVE_ALL", "REMOVE_ALL_STRICT")


def as_interactions(tables: DataFrame) -> DataFrame:
    """Tables as interactions without questions; the table's id is the interaction's."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in tables.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields]
    none = F.array().cast(INTERACTION["questions"].dataType)
    return tables.select(F.col("table_id").alias("id"), F.struct(*fields).alias("table"), none.alias("questions"))


def inputs(df: DataFrame, kind: str) -> DataFrame:
    """INTERACTION rows as they are, TABLE rows promoted."""
    if kind not in ("INTERACTION", "TABLE"):
        raise ValueError(f"unknown input format: {kind}")
    return df if kind == "INTERACTION" else as_interactions(df)


def large_enough(interactions: DataFrame, rows: int, columns: int) -> DataFrame:
    return interactions.where((F.size("table.rows") >= rows) & (F.size("table.columns") >= columns))


def answer_text_is_valid(c: Column) -> Column:
    return F.coalesce(~F.trim(c).isin(*NO_ANSWERS), F.lit(False))


def pieces_are_valid(c: Column) -> Column:
    """Some piece, and not only those of empty cells."""
    return F.coalesce(F.exists(c, lambda p: p != EMPTY_PIECE), F.lit(False))


def choose_answers(groups: DataFrame) -> DataFrame:
    """``(question_id, answer, alternatives)`` of ``(question_id, group_index, answers, located)`` rows.

    The first group (by index) whose answers are all located is the answer, later ones are alternatives; questions
    without one are left out.
    """
    whole = groups.where((F.size("answers") > 0) & F.forall("located", lambda x: F.coalesce(x, F.lit(False))))
    lists = whole.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("group_index", "answers"))).alias("g"))
    return lists.select("question_id", F.col("g")[0]["answers"].alias("answer"), F.transform(F.slice("g", F.lit(2), F.size("g")), lambda x: x["answers"]).alias("alternatives"))


def without_table(interactions: DataFrame) -> DataFrame:
    """The same questions on a table of no columns and rows, for comparison with text alone."""
    empty = F.struct(F.col("table.table_id").alias("table_id"), *[F.lit(None if f.name.startswith("document") else []).cast(f.dataType).alias(f.name) if f.name.startswith("document") else F.array().cast(f.dataType).alias(f.name) for f in TABLE.fields[1:]])
    return interactions.withColumn("table", empty)


def supervise(questions: DataFrame, mode: str) -> DataFrame:
    """``coordinates``, ``aggregation`` and ``float_answer`` as the mode of supervision leaves them.

    NONE keeps them. REMOVE_ALL clears them and takes the number from a single answer text that is one; cells are
    found again by :func:`match.locate`. REMOVE_ALL_STRICT takes no number where the answer was a cell.
    """
    from ..functions import numbers

    if mode not in MODES:
        raise ValueError(f"unknown supervision mode: {mode}")
    if mode == "NONE":
        return questions
    number = F.when(F.size("answer_texts") == 1, numbers.to_float(F.col("answer_texts")[0]).cast("float"))
    number = F.when(F.size(F.coalesce("coordinates", F.array())) == 0, number) if mode == "REMOVE_ALL_STRICT" else number
    kinds = dict(questions.dtypes)
    return questions.withColumns({"float_answer": number, "coordinates": F.array().cast(kinds["coordinates"]), "aggregation": F.lit(None).cast(kinds["aggregation"])})


def pretraining(interactions: DataFrame, copies: int, rows: int, columns: int, tests: int = 100) -> DataFrame:
    """Interactions with questions and a large enough table, ``copies`` times, with ``split`` by the hash of the table's id."""
    kept = large_enough(interactions.where(F.size("questions") > 0), rows, columns)
    return synth.amplify(kept, "id", copies).withColumn("split", text.split_of(F.col("table.table_id"), tests))


def fit_rows(cells: DataFrame, n_rows: str, cost: Column, budget: int) -> DataFrame:
    """Cells of the leading rows of each table whose running cost stays within the budget: trailing rows are dropped."""
    per_row = cells.groupBy("table_id", n_rows).agg(F.sum(cost).alias("_c"))
    run = per_row.withColumn("_run", F.sum("_c").over(Window.partitionBy("table_id").orderBy(n_rows))).where(F.col("_run") <= budget)
    return cells.join(run.select("table_id", n_rows), ["table_id", n_rows], "left_semi")


def masked_words(pieces: Column, seed: Column, vocabulary: Column | list[str], inner: str = "##", share: float = 0.15, most: int = 20) -> Column:
    """Masked-text instances ``array<struct<index, label, shown>>`` of a piece list, whole words at a time.

    A word is a piece and the ``inner`` ones that follow. Words are taken in a seeded order while they fit into
    min(most, max(1, round(share * pieces))) places. Of the places 8 in 10 show ``[MASK]``, 1 in 10 keep their piece
    and 1 in 10 show a piece drawn from ``vocabulary``, a list or an array column (of a joined row, where it is long).
    """
    entries = vocabulary if isinstance(vocabulary, Column) else F.array(*map(F.lit, vocabulary))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.round(F.size(pieces) * share).cast("int")))
    draw = lambda i, kind: F.pmod(F.xxhash64(seed, i, F.lit(kind)), F.lit(10))
    places = F.sequence(F.lit(0), F.size(pieces) - 1)
    starts = F.filter(places, lambda i: ~F.startswith(F.get(pieces, i), F.lit(inner)) | (i == 0))
    words = F.transform(starts, lambda s, k: F.struct(F.xxhash64(seed, s, F.lit("order")).alias("h"), s.alias("start"), (F.coalesce(F.get(starts, k + 1), F.size(pieces)) - s).alias("size")))
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<start:int,size:int>>").alias("words"))
    fits = lambda s, w: s["used"] + w["size"] <= n
    step = lambda s, w: F.when(fits(s, w), F.struct((s["used"] + w["size"]).alias("used"), F.concat(s["words"], F.array(F.struct(w["start"].alias("start"), w["size"].alias("size")))).alias("words"))).otherwise(s)
    taken = F.aggregate(F.array_sort(words), none, step, lambda s: s["words"])
    at = F.array_sort(F.flatten(F.transform(taken, lambda w: F.sequence(w["start"], w["start"] + w["size"] - 1))))
    shown = lambda i: F.when(draw(i, "kind") < 8, F.lit("[MASK]")).when(draw(i, "kind") == 8, F.get(pieces, i)).otherwise(F.get(entries, F.pmod(F.xxhash64(seed, i, F.lit("word")), F.size(entries)).cast("int")))
    out = F.transform(at, lambda i: F.struct(i.alias("index"), F.get(pieces, i).alias("label"), shown(i).alias("shown")))
    return F.when(F.size(pieces) > 0, out)


def snippet(tokens: Column, seed: Column, least: int, most: int) -> Column:
    """A seeded run of ``least`` to ``most`` tokens (all, if there are fewer)."""
    width = F.least(F.size(tokens), (F.pmod(F.xxhash64(seed, F.lit("width")), F.lit(most - least + 1)) + least).cast("int"))
    start = F.pmod(F.xxhash64(seed, F.lit("start")), F.size(tokens) - width + 1).cast("int")
    return F.when(F.size(tokens) > 0, F.slice(tokens, start + 1, width)).otherwise(tokens)


def table_size(rows: Column, columns: Column, seed: Column, cells: int) -> Column:
    """A seeded ``struct<rows, columns>`` of a table's part that has at most ``cells`` cells, of one each at least."""
    wide = (F.pmod(F.xxhash64(seed, F.lit("columns")), F.greatest(F.least(columns, F.lit(cells)), F.lit(1))) + 1).cast("int")
    room = F.greatest(F.least(rows, F.floor(F.lit(cells) / wide)), F.lit(1))
    return F.struct((F.pmod(F.xxhash64(seed, F.lit("rows")), room) + 1).cast("int").alias("rows"), wide.alias("columns"))


#: Interactions of a bin, out of which a random table is taken.
BIN_ROWS = 512


def with_random_table(interactions: DataFrame, seed: int = 0, bins: int | None = None) -> DataFrame:
    """``other``: another interaction's table (of the same hash bin, the next one in a seeded order) for half of the rows.

    There is a bin for every ``BIN_ROWS`` interactions, so a window's tables are of a bounded number, whatever the
    corpus; alone in its bin, an interaction gets none.
    """
    bins = bins or max(1, interactions.count() // BIN_ROWS)
    bin_of = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(bins))
    order = Window.partitionBy(bin_of).orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    around = Window.partitionBy(bin_of)
    after = F.coalesce(F.lead("table").over(order), F.first("table").over(order))
    lucky = F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(2)) == 0
    return interactions.withColumns({"_n": F.count("*").over(around), "_after": after}).withColumn("other", F.when(lucky & (F.col("_n") > 1), F.col("_after"))).drop("_n", "_after")
