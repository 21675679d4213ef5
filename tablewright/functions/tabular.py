"""Functions that are called from SQL: table functions with state for each partition, and an aggregate over Arrow.

``register`` puts them under their names. A table function's ``analyze`` reads the call once, checks it and says what
comes out; its object is made once for each partition and may answer row by row or at the end.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.window import Window


class TokenArrays:
    """``token_arrays(TABLE(t), length => 8)``: one row of fixed-width arrays for each question.

    The table has ``question_id, pos, token_id, segment_id, column_id, row_id``. ``analyze`` asks for rows by question in
    the order of ``pos``, so the caller need not. Tokens beyond ``length`` are cut off and counted.

    Spark hands each row of a table over by itself, a token costs some 80 microseconds. Large tables are called beside
    ``whole_questions``: ``LATERAL token_arrays(question_id, n_tokens, token_id, segment_id, column_id, row_id, length => 8)``
    takes a question's number of tokens and arrays of its first ones, in order.
    """

    ARRAYS = ("token_id", "segment_id", "column_id", "row_id")

    @staticmethod
    def analyze(rows: AnalyzeArgument, *whole: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable and not whole:
            raise ValueError("the first argument must be a table")
        if whole and (rows.isTable or len(whole) != 1 + len(TokenArrays.ARRAYS) or not all(isinstance(a.dataType, ArrayType) for a in whole[1:])):
            raise ValueError(f"a question is its id, its number of tokens and the arrays {', '.join(TokenArrays.ARRAYS)}")
        kinds = {f.name: f.dataType for f in rows.dataType.fields} if not whole else {"question_id": rows.dataType}
        missing = {"question_id", "pos", *TokenArrays.ARRAYS} - set(kinds)
        if missing and not whole:
            raise ValueError(f"missing columns: {sorted(missing)}")
        if not length.isConstantExpression or length.value is None or length.value < 1:
            raise ValueError("length must be a positive constant")
        arrays = [StructField(f"{n}s", ArrayType(IntegerType())) for n in TokenArrays.ARRAYS]
        schema = StructType([StructField("question_id", kinds["question_id"]), *arrays, StructField("input_mask", ArrayType(IntegerType())), StructField("lost", LongType())])
        if whole:
            return AnalyzeResult(schema)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("question_id")], orderBy=[OrderingColumn("pos")])

    def __init__(self):
        self.question, self.rows, self.length, self.lost = None, [], 0, 0

    def eval(self, row, *whole, length: int):
        if whole:
            n, *arrays = whole
            shown = min(length, len(arrays[0]))
            pad = [0] * (length - shown)
            return [(row, *[a[:length] + pad for a in arrays], [1] * shown + pad, n - shown)]
        self.question, self.length = row["question_id"], length
        if len(self.rows) < length:
            self.rows.append([row[n] for n in self.ARRAYS])
        else:
            self.lost += 1

    def terminate(self):
        if not self.rows:
            return
        pad = self.length - len(self.rows)
        arrays = [[r[i] for r in self.rows] + [0] * pad for i in range(len(self.ARRAYS))]
        yield (self.question, *arrays, [1] * len(self.rows) + [0] * pad, self.lost)


def whole_questions(tokens: DataFrame, length: int) -> DataFrame:
    """``(question_id, n_tokens, token_id, segment_id, column_id, row_id)``, a row for each question: how many tokens it has and
    arrays of the first ``length`` by ``pos``. No more of them are held, however long a question is."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("pos"))
    token = F.when(F.col("_place") <= length, F.struct("_place", *TokenArrays.ARRAYS))  # nulls are not collected
    one = tokens.withColumn("_place", place).groupBy("question_id").agg(F.count("*").alias("n_tokens"), F.array_sort(F.collect_list(token)).alias("_t"))
    return one.select("question_id", "n_tokens", *[F.col(f"_t.{n}").alias(n) for n in TokenArrays.ARRAYS])


class TableCells:
    """``table_cells(json)``: a row for each cell of a JSON table ``{"columns": [...], "rows": [[...], ...]}``.

    Called beside a table (LATERAL) it makes none to many rows of each of its rows. Rows that are too short have null
    cells; a text that is no such table has no cells.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(table.dataType, StringType):
            raise ValueError("the table must be JSON text")
        return AnalyzeResult(StructType().add("row_index", IntegerType()).add("column_index", IntegerType()).add("column_name", StringType()).add("text", StringType()))

    def eval(self, table: str):
        try:
            read = json.loads(table or "")
            columns, rows = read["columns"], read["rows"]
        except (ValueError, KeyError, TypeError):
            return
        for i, row in enumerate(rows):
            for j, name in enumerate(columns):
                cell = row[j] if j < len(row) else None
                yield i, j, name, None if cell is None else str(cell)


def weighted_median(value: pa.Array, weight: pa.Array) -> float:
    """The least value at which the weights up to it reach half of all; null without positive weights. One group, one task."""
    ok = pc.and_kleene(pc.is_valid(value), pc.greater(pc.fill_null(weight, 0.0), 0.0))
    value, weight = value.filter(ok), weight.filter(ok)
    if not len(value):
        return None
    order = pc.sort_indices(value)
    sums = pc.cumulative_sum(weight.take(order))
    reached = pc.greater_equal(sums, sums[-1].as_py() / 2)
    return value.take(order)[pc.index(reached, True).as_py()].as_py()


def register(spark: SparkSession) -> None:
    """Registers ``token_arrays``, ``table_cells`` and ``weighted_median`` for SQL text on this session."""
    spark.udtf.register("token_arrays", F.udtf(TokenArrays))
    spark.udtf.register("table_cells", F.udtf(TableCells))
    spark.udf.register("weighted_median", F.arrow_udf(weighted_median, "double"))
