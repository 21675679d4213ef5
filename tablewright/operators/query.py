"""The structured query (one column, conjunctive conditions, one aggregation) and its statement grammar."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text

EQUALS, GREATER, LESSER = "=", ">", "<"


@dataclass(frozen=True)
class Condition:
    column: str
    comparator: str
    value: object

    def holds(self, real: bool) -> Column:
        """Numbers compare as numbers; texts as lower-cased token lists, element by element."""
        left = F.col(self.column) if real else text.tokenize(F.col(self.column).cast("string"))
        right = F.lit(self.value) if real else text.tokenize(F.lit(str(self.value)))
        return {EQUALS: left == right, GREATER: left > right, LESSER: left < right}[self.comparator]


@dataclass(frozen=True)
class TableQuery:
    """``select`` one column of the rows where all conditions hold, through ``agg`` (NONE, MAX, MIN, COUNT, SUM, AVERAGE)."""

    select: str
    agg: str = "NONE"
    where: tuple[Condition, ...] = field(default_factory=tuple)

    def rows(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        real = lambda c: kinds[c.column] not in ("string",) and not isinstance(c.value, str)
        for c in self.where:
            if kinds[c.column] == "string" and not isinstance(c.value, str):
                raise TypeError(f"{c.column} is text, its condition a number")
        return df.where(functools.reduce(lambda a, b: a & b, [c.holds(real(c)) for c in self.where], F.lit(True)))

    def answer(self, df: DataFrame) -> DataFrame:
        """One row ``answer``: a count of no cells is 0.0, other aggregates of none are NaN, of texts null."""
        number = numbers.to_float(F.col(self.select).cast("string"))
        rows = self.rows(df)
        if self.agg == "COUNT":
            return rows.agg(F.count("*").cast("double").alias("answer"))
        value = {"SUM": F.sum(number), "AVERAGE": F.avg(number), "MAX": F.max(number), "MIN": F.min(number), "NONE": F.max(number)}[self.agg]
        one = F.count("*") == 1 if self.agg == "NONE" else F.lit(True)
        return rows.agg(F.when(F.count("*") == 0, F.lit(float("nan"))).when((F.count_if(number.isNull()) == 0) & one, value).alias("answer"))


def extreme_cell(df: DataFrame, group: list[str], value: str, position: str, greatest: bool) -> DataFrame:
    """The cell of the least or greatest value; least ties go to the first position, greatest to the last."""
    pick = (F.max if greatest else F.min)(F.struct(F.col(value).alias("value"), F.col(position).alias("position")))
    return df.groupBy(*group).agg(pick.alias("_p")).select(*group, "_p.value", "_p.position")


def grammar_aggregates(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """LOWEST, GREATEST, FIRST, LAST, SUM, RANGE and AVERAGE; all need two rows, else they are null."""
    enough = F.count("*") >= 2
    first = lambda c: F.when(enough, c)
    return df.groupBy(*group).agg(
        first(F.min(value)).alias("lowest"), first(F.max(value)).alias("greatest"), first(F.min_by(value, position)).alias("first_value"), first(F.max_by(value, position)).alias("last_value"),
        first(F.sum(value)).alias("total"), first(F.max(value) - F.min(value)).alias("value_range"), first(F.avg(value)).alias("average"),
    )


def nonzero_count() -> Column:
    """The grammar's count: an empty row set is an error (null), never 0."""
    return F.nullif(F.count(F.lit(1)), F.lit(0).cast("bigint"))


def compare_sets(left: Column, right: Column, comparator: str) -> Column:
    """Three-valued: true, false, or null (error) for an empty side or one that does not compare."""
    usable = (F.size(left) > 0) & (F.size(right) > 0) & ~F.exists(left, lambda v: v.isNull()) & ~F.exists(right, lambda v: v.isNull())
    value = {
        EQUALS: F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right)),
        LESSER: F.array_max(left) < F.array_min(right),
        GREATER: F.array_min(left) > F.array_max(right),
    }[comparator]
    return F.when(usable, value)


def all_hold(conditions: list[Column]) -> Column:
    """A conjunction in which an error outweighs a false condition (unlike SQL's AND)."""
    return F.when(functools.reduce(lambda a, b: a | b, [c.isNull() for c in conditions]), F.lit(None).cast("boolean")).otherwise(functools.reduce(lambda a, b: a & b, conditions))


def where_number(df: DataFrame, column: str, comparator: str, value: float) -> DataFrame:
    """Rows whose text compares as a number; none at all if any row's text is not a number."""
    number = numbers.to_float(column)
    flags = df.agg(F.bool_or(number.isNull() & F.col(column).isNotNull()).alias("_bad"))
    hit = {EQUALS: number == value, GREATER: number > value, LESSER: number < value}[comparator]
    return df.crossJoin(flags).where(hit & ~F.coalesce("_bad", F.lit(False))).drop("_bad")  # flags: one row


def verbalize(aggregate: Column, column: str, conditions: list[Condition]) -> Column:
    """``the total X when A is b and C is greater than 3``."""
    word = {EQUALS: "is", GREATER: "is greater than", LESSER: "is less than"}
    said = " and ".join(f"{c.column} {word[c.comparator]} {c.value}" for c in conditions)
    return F.concat(F.lit("the "), aggregate, F.lit(f" {column}" + (f" when {said}" if said else "")))
