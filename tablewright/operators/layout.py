"""Token layouts of tables under a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def knapsack(columns: Column, budget: int) -> Column:
    """Greedy choice from an array of ``struct<priority, id, cost>``: in order of priority, what fits is taken, what
    does not is skipped. Returns the ids taken, in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fits = lambda s, c: s["used"] + c["cost"] <= budget
    step = lambda s, c: F.struct(F.when(fits(s, c), s["used"] + c["cost"]).otherwise(s["used"]).alias("used"), F.when(fits(s, c), F.concat(s["ids"], F.array(c["id"].cast("bigint")))).otherwise(s["ids"]).alias("ids"))
    return F.aggregate(F.sort_array(columns), start, step, lambda s: s["ids"])


def largest_length(cells: DataFrame, group: list[str], size: Column, budget: int) -> DataFrame:
    """The largest number of tokens T a cell may keep so that the group's cells, each cut at T, fit the budget.

    Costs grow by one for each cell of more than T tokens, so they are sums over the distinct sizes: a window over a
    histogram. Where all cells fit whole, T is the longest; 0 means that not even one token each fits.
    """
    sizes = cells.select(*group, size.cast("long").alias("_s")).where("_s > 0").groupBy(*group, "_s").agg(F.count("*").alias("_n"))
    up, down = Window.partitionBy(*group).orderBy("_s"), Window.partitionBy(*group).orderBy(F.desc("_s"))
    steps = sizes.withColumns({"_from": F.coalesce(F.lag("_s").over(up), F.lit(0)), "_more": F.sum("_n").over(down)})
    steps = steps.withColumn("_cost", F.sum((F.col("_s") - F.col("_from")) * F.col("_more")).over(up))
    left = F.lit(budget) - (F.col("_cost") - (F.col("_s") - F.col("_from")) * F.col("_more"))  # before this step
    reach = F.least(F.col("_s"), F.col("_from") + F.floor(left / F.col("_more")))
    found = steps.groupBy(*group).agg(F.max(F.when(left >= 0, reach)).cast("int").alias("_t"))
    return cells.select(*group).distinct().join(found, group, "left").select(*group, F.coalesce("_t", F.lit(0)).alias("length"))


def trim_tokens(tokens: DataFrame, group: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Leading tokens whose running cost stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("_used", F.sum(cost).over(w)).where(F.col("_used") <= budget).drop("_used")


def pad(values: Column, length: int, filler=0) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler), length)), 1, length)


def features(tokens: DataFrame, length: int) -> DataFrame:
    """``(question_id, pos, token_id, segment_id, column_id, row_id)`` rows to fixed-width arrays for each question."""
    names = ["token_id", "segment_id", "column_id", "row_id"]
    one = tokens.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("_t"))
    mask = pad(F.transform("_t", lambda _: F.lit(1)), length).alias("input_mask")
    column = lambda n: pad(F.transform("_t", lambda x: x[n]), length).alias(f"{n}s")
    return one.select("question_id", *[column(n) for n in names], mask)


def shard_ranges(n_rows: Column, n_cols: Column, cells: int = 50, least: int = 2) -> Column:
    """Row ranges ``struct<begin, end>`` of shards of at most ``cells`` cells, those under ``least`` rows left out.

    A range that holds too many rows is cut at its middle, the smaller half first, and a half that fits is cut no
    further. A table of more than ``cells`` columns has no shards.
    """
    most = F.floor(F.lit(cells) / n_cols).cast("int")
    depth = F.ceil(F.log2(F.greatest(n_rows, F.lit(1)) / most)).cast("int") + 1  # a half of an odd range has one row more
    middle = lambda r: r["begin"] + F.floor((r["end"] - r["begin"]) / 2).cast("int")
    part = lambda begin, end: F.struct(begin.alias("begin"), end.alias("end"))
    halved = lambda rs: F.flatten(F.transform(rs, lambda r: F.when(r["end"] - r["begin"] <= most, F.array(r)).otherwise(F.array(part(r["begin"], middle(r)), part(middle(r), r["end"])))))
    whole = F.array(part(F.lit(0), n_rows.cast("int")))
    ranges = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), whole, lambda rs, _: halved(rs))
    return F.when(most > 0, F.filter(ranges, lambda r: r["end"] - r["begin"] >= least)).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))


#: Relations of token pairs, in the order of their numbers from 1; 0 is none of them, or padding.
RELATIONS = (
    "same_row", "same_column", "same_cell", "cell_to_header", "cell_to_sentence", "header_to_cell", "header_to_other_header", "header_to_same_header",
    "header_to_sentence", "sentence_to_cell", "sentence_to_header", "sentence_to_sentence",
)


def relations(segment: Column, column: Column, row: Column, mask: Column | None = None, without: str | None = None) -> Column:
    """Relation numbers of all token pairs of one sequence, an array of rows, from the first token to the second.

    Sentence tokens have segment 0, table tokens segment 1, a column from 1 on and row 0 in the header. Places where
    ``mask`` is 0 are padding and related to nothing. Of two cells' relations the same cell outweighs the others.
    ``without`` leaves one relation out, which is then 0.
    """
    number = {r: i + 1 for i, r in enumerate(RELATIONS)}
    real = F.transform(segment, lambda _: F.lit(1)) if mask is None else mask
    #: "s" sentence, "h" header, "c" cell, "p" padding
    kinds = F.transform(F.arrays_zip(real.alias("m"), segment.alias("s"), row.alias("r")), lambda t: F.when(t["m"] == 0, "p").when(t["s"] == 0, "s").when(t["r"] == 0, "h").otherwise("c"))
    tokens = F.arrays_zip(kinds.alias("k"), column.alias("c"), row.alias("r"))

    def pair(a: Column, b: Column) -> Column:
        both, same_column, same_row = F.concat(a["k"], b["k"]), a["c"] == b["c"], a["r"] == b["r"]
        named = {"cs": "cell_to_sentence", "hs": "header_to_sentence", "sc": "sentence_to_cell", "sh": "sentence_to_header", "ss": "sentence_to_sentence"}
        cases = [(both == k, name) for k, name in named.items()] + [
            ((both == "ch") & same_column, "cell_to_header"), ((both == "hc") & same_column, "header_to_cell"),
            ((both == "hh") & same_column, "header_to_same_header"), (both == "hh", "header_to_other_header"),
            ((both == "cc") & same_column & same_row, "same_cell"), ((both == "cc") & same_column, "same_column"), ((both == "cc") & same_row, "same_row"),
        ]
        out = F.lit(0)
        for holds, name in reversed(cases):
            out = F.when(holds, F.lit(0 if name == without else number[name])).otherwise(out)
        return out

    return F.transform(tokens, lambda a: F.transform(tokens, lambda b: pair(a, b)))


def span_mask(spans: Column, column: Column, row: Column) -> Column:
    """1 for spans ``struct<begin, end>`` whose first and last token are in one cell below the header, else 0."""
    same = lambda ids, s: (F.get(ids, s["begin"]) == F.get(ids, s["end"])) & (F.get(ids, s["begin"]) > 0)
    return F.transform(spans, lambda s: F.coalesce(same(column, s) & same(row, s), F.lit(False)).cast("int"))


def answer_labels(tokens: DataFrame, answers: DataFrame, strict: bool = True) -> DataFrame:
    """``label`` 1 for tokens of an answer cell ``(question_id, column_id, row_id)``, else 0; a cell that no token shows is an error."""
    cells = answers.select("question_id", "column_id", "row_id").distinct()
    met = tokens.withColumn("_t", F.lit(1)).join(cells.withColumn("label", F.lit(1)), ["question_id", "column_id", "row_id"], "full")
    lost = F.when(F.col("_t").isNull(), F.raise_error(F.lit("an answer cell has no token"))).otherwise(F.coalesce("label", F.lit(0)))
    return (met.withColumn("label", lost) if strict else met.where("_t is not null").withColumn("label", F.coalesce("label", F.lit(0)))).select(*tokens.columns, "label")


def numeric_scale(tokens: DataFrame) -> DataFrame:
    """``numeric_value`` (NaN without one) and ``scale``, the number of tokens that share the value's cell (else 1)."""
    cell = Window.partitionBy("question_id", "column_id", "row_id")
    inside = (F.col("column_id") > 0) & (F.col("row_id") > 0)
    return tokens.withColumns({"numeric_value": F.coalesce("value", F.lit(float("nan"))), "scale": F.when(inside, F.count("*").over(cell)).otherwise(F.lit(1)).cast("double")})


def tokens_of_cells(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """``(question_id, column_id, row_id, positions)`` for each asked cell; cells without tokens have none."""
    keys = ["question_id", "column_id", "row_id"]
    lists = tokens.join(cells.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return cells.select(*keys).distinct().join(lists, keys, "left").withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))


def gather_top(scores: Column, features: dict[str, Column], k: int) -> list[Column]:
    """Every feature cut to the ``k`` places of the best scores, in the order of the scores, ties by place."""
    places = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    best = F.transform(F.slice(F.array_sort(places), 1, k), lambda p: p["i"])
    return [F.transform(best, lambda i: F.get(c, i)).alias(n) for n, c in features.items()]


def boost_previous(scores: DataFrame, previous: DataFrame, group: list[str], column: str, score: str) -> DataFrame:
    """``priority`` (less is earlier): the negated score, or, for columns of the previous answer, less than all others."""
    marked = scores.join(previous.select(*group, column).distinct().withColumn("_p", F.lit(True)), [*group, column], "left")
    n = F.count("*").over(Window.partitionBy(*group))
    low = F.min(-F.col(score)).over(Window.partitionBy(*group))
    return marked.withColumn("priority", F.when(F.col("_p"), low - n - 1).otherwise(-F.col(score))).drop("_p")


def padded(examples: DataFrame, id_col: str, batch: int, filler: str = "EMPTY-0_0") -> DataFrame:
    """Examples and as many empty ones as make their number a multiple of ``batch``; sinks leave fillers out."""
    missing = examples.agg(F.pmod(-F.count("*"), F.lit(batch)).cast("int").alias("m")).where("m > 0").select(F.explode(F.array_repeat(F.lit(filler), F.col("m"))).alias(id_col))
    return examples.unionByName(missing, allowMissingColumns=True)
