"""Statements about tables drawn from a grammar, true and false, with tables on which their truth turns.

A condition compares two expressions; an expression aggregates a column, or counts rows, under filters. Conditions
are drawn whole and kept if they have the wanted truth, so no part of a draw needs to know of the others.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.numbers import read_float

# The words of the grammar.
SELECTS = {
    "NONE": "{}", "LOWEST": "the lowest {}", "GREATEST": "the greatest {}", "FIRST": "the first {}", "LAST": "the last {}",
    "SUM": "the total {}", "RANGE": "the range of {}", "AVERAGE": "the average {}", "COUNT": "the count",
}
COMPARES = {"EQUALS": "is", "LESSER": "is less than", "GREATER": "is greater than"}
_COMPARES, _COLUMN_SELECTS = list(COMPARES), [s for s in SELECTS if s != "COUNT"]


@dataclasses.dataclass(frozen=True)
class Odds:
    """How statements are drawn. ``tries``: whole conditions drawn for each wanted truth before a table is given up."""

    constant: float = 0.5
    stop: float = 0.5
    count: float = 0.2
    tries: int = 400
    shuffles: int = 4


@dataclasses.dataclass(frozen=True)
class Filter:
    column: str
    compare: str
    value: str


@dataclasses.dataclass(frozen=True)
class Expression:
    """``select`` of ``column`` over the rows that pass all filters; with ``constant``, those values whatever the table."""

    select: str = "COUNT"
    column: str = ""
    filters: tuple[Filter, ...] = ()
    constant: tuple[str, ...] | None = None

    def say(self) -> str:
        if self.constant is not None:
            return ", ".join(self.constant) or "empty"
        filters = " and ".join(f"{f.column} {COMPARES[f.compare]} {f.value}" for f in self.filters)
        return SELECTS[self.select].format(self.column) + (f" when {filters}" if filters else "")


@dataclasses.dataclass(frozen=True)
class Condition:
    left: Expression
    compare: str
    right: Expression

    def say(self) -> str:
        return f"{self.left.say()} {COMPARES[self.compare]} {self.right.say()}"

    def as_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))


def shown(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:.2f}"


class Grid:
    """A table by columns: texts, and numbers with NaN where a text is none."""

    def __init__(self, texts: dict[str, list[str]]):
        self.texts = {name: list(column) for name, column in texts.items()}
        self.numbers = {name: [_number(x) for x in column] for name, column in texts.items()}
        self.rows = len(next(iter(texts.values()), []))

    def shuffled(self, column: str, order: list[int]) -> Grid:
        out = Grid.__new__(Grid)
        out.texts, out.numbers, out.rows = dict(self.texts), dict(self.numbers), self.rows
        texts, numbers = self.texts[column], self.numbers[column]
        out.texts[column], out.numbers[column] = [texts[i] for i in order], [numbers[i] for i in order]
        return out

    def values(self, e: Expression) -> frozenset[str] | None:
        """The expression's values; None where it has none: no rows, one row to aggregate, texts where numbers are due."""
        if e.constant is not None:
            return frozenset(e.constant)
        at = range(self.rows)  # lists: tables are small, and an array's fixed costs are most of a draw's
        for f in e.filters:
            if f.compare == "EQUALS":
                texts, value = self.texts[f.column], f.value
                at = [i for i in at if texts[i] == value]
                continue
            numbers, bound = self.numbers[f.column], _number(f.value)
            if bound != bound or any(numbers[i] != numbers[i] for i in at):
                return None
            at = [i for i in at if numbers[i] < bound] if f.compare == "LESSER" else [i for i in at if numbers[i] > bound]
        if not at:
            return None
        if e.select == "COUNT":
            return frozenset([str(len(at))])
        texts = self.texts[e.column]
        if e.select == "NONE":
            return frozenset([texts[i] for i in at])
        if len(at) < 2:
            return None
        if e.select in ("FIRST", "LAST"):
            return frozenset([texts[at[0 if e.select == "FIRST" else -1]]])
        numbers = self.numbers[e.column]
        if any(numbers[i] != numbers[i] for i in at):
            return None
        if e.select in ("LOWEST", "GREATEST"):
            return frozenset([texts[(min if e.select == "LOWEST" else max)(at, key=numbers.__getitem__)]])
        numbers = np.array([numbers[i] for i in at])
        return frozenset([shown({"SUM": numbers.sum, "RANGE": lambda: np.ptp(numbers), "AVERAGE": numbers.mean}[e.select]())])

    def holds(self, c: Condition) -> bool | None:
        """Whether the condition is true; None where a side has no values or they do not compare."""
        left = self.values(c.left)
        right = None if left is None else self.values(c.right)
        return None if right is None else compared(left, c.compare, right)


def compared(left: frozenset[str], compare: str, right: frozenset[str]) -> bool | None:
    """Sets: equal, or all of the left below (above) all of the right; None unless both are numbers, or for an empty side."""
    if compare == "EQUALS":
        return left == right
    a, b = [_number(x) for x in left], [_number(x) for x in right]
    if not a or not b or any(x != x for x in a) or any(x != x for x in b):
        return None
    return max(a) < min(b) if compare == "LESSER" else min(a) > max(b)


@functools.lru_cache(maxsize=1 << 16)
def _number(text: str) -> float:
    found = read_float(text)
    return float("nan") if found is None else found


def _below(rng: random.Random, n: int) -> int:
    bits = n.bit_length()
    found = rng.getrandbits(bits)
    while found >= n:
        found = rng.getrandbits(bits)
    return found


def _any(rng: random.Random, items: list):
    """What ``rng.choice`` draws, without its checks."""
    return items[_below(rng, len(items))]


def _order(rng: random.Random, items) -> list:
    """What ``rng.sample`` of all items draws, without its checks."""
    pool, out, bits = list(items), [], rng.getrandbits
    for left in range(len(pool), 0, -1):
        k = left.bit_length()
        at = bits(k)
        while at >= left:
            at = bits(k)
        out.append(pool[at])
        pool[at] = pool[left - 1]
    return out


class _Drawer:
    def __init__(self, grid: Grid, odds: Odds, rng: random.Random):
        self.grid, self.odds, self.rng, self.names = grid, odds, rng, sorted(grid.texts)

    def filters(self) -> tuple[Filter, ...]:
        out = []
        for name in _order(self.rng, self.names):
            if self.rng.random() < self.odds.stop:
                break
            out.append(Filter(name, _any(self.rng, _COMPARES), _any(self.rng, self.grid.texts[name])))
        return tuple(out)

    def condition(self, truth: bool) -> Condition | None:
        """One draw; None unless it has the wanted truth."""
        counting = self.rng.random() < self.odds.count
        column = "" if counting else _any(self.rng, self.names)
        sides = [Expression("COUNT" if counting else _any(self.rng, _COLUMN_SELECTS), column, self.filters()) for _ in range(2)]
        values = []
        for e in sides:
            values.append(self.grid.values(e))
            if values[-1] is None:
                return None
        fitting = [c for c in COMPARES if compared(values[0], c, values[1]) is truth]
        if not fitting:
            return None
        given = [Expression("", "", (), tuple(sorted(v))) for v in values]
        if sides[0] == sides[1] or self.rng.random() < self.odds.constant:
            sides[0] = given[0]
        elif self.rng.random() < self.odds.constant:
            sides[1] = given[1]
        return Condition(sides[0], _any(self.rng, fitting), sides[1])

    def turned(self, condition: Condition, truth: bool) -> tuple[str, list[int]] | None:
        """A column and an order of its cells under which the condition's truth turns; other columns than its own cannot turn it."""
        sides = [e for e in (condition.left, condition.right) if e.constant is None]
        named = {e.column for e in sides if e.column} | {f.column for e in sides for f in e.filters}
        for column in _order(self.rng, sorted(named)):
            for _ in range(self.odds.shuffles):
                order = _order(self.rng, range(self.grid.rows))
                if self.grid.shuffled(column, order).holds(condition) is (not truth):
                    return column, order
        return None

    def draw(self, truth: bool, opposite: bool) -> tuple[Condition, tuple[str, list[int]] | None] | None:
        for _ in range(self.odds.tries):
            condition = self.condition(truth)
            turned = self.turned(condition, truth) if condition is not None and opposite else None
            if condition is not None and (turned is not None or not opposite):
                return condition, turned
        return None


OUT = "table_id string, statement string, condition string, label int, shuffled_column string, shuffled array<string>"


def statements(cells: DataFrame, opposite: bool = True, odds: Odds | None = None, seed: int = 0) -> DataFrame:
    """For each table of ``(table_id, row_index, column_name, text)`` one true and one false statement, in words and as JSON.

    With ``opposite`` each comes twice: on the table, and with the other label on the table whose column
    ``shuffled_column`` holds the texts ``shuffled`` (rows in order). Draws depend on the table's id and the seed, not on
    row order or partitions. Null texts are empty. No statement is made of a table of fewer than two rows, of one in
    which no draw fits, or of one with two columns of a name or with two cells in a place. A table is one group; those of a corpus are small.
    """
    odds = odds or Odds()
    kinds = pa.schema([("table_id", pa.string()), ("statement", pa.string()), ("condition", pa.string()), ("label", pa.int32()), ("shuffled_column", pa.string()), ("shuffled", pa.list_(pa.string()))])
    made = lambda out: pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in out], kinds)

    def run(one: pa.Table) -> pa.Table:
        table, out = one.column("table_id")[0].as_py(), []
        rows, columns, cells = (one.column(c).to_pylist() for c in ("row_index", "column_name", "text"))
        if table is None or len(set(zip(rows, columns))) < len(rows) or None in columns:
            return made(out)
        names, at = sorted(set(columns)), {row: i for i, row in enumerate(sorted(set(rows), key=lambda r: (r is None, r)))}
        texts = {name: [""] * len(at) for name in names}
        for row, name, text in zip(rows, columns, cells):
            texts[name][at[row]] = text or ""
        grid = Grid(texts)
        drawer = _Drawer(grid, odds, random.Random(f"{seed}|{table}"))
        for truth in (True, False) if grid.rows >= 2 else ():
            found = drawer.draw(truth, opposite)
            if found is None:
                continue
            condition, turned = found
            out.append((table, condition.say(), condition.as_json(), int(truth), None, None))
            if turned is not None:
                column, order = turned
                out.append((table, condition.say(), condition.as_json(), int(not truth), column, [grid.texts[column][i] for i in order]))
        return made(out)

    wanted = cells.selectExpr("string(table_id) AS table_id", "row_index", "column_name", "text")
    # A stated number of partitions: drawing is heavy for its bytes, and few tasks would be made of them by size.
    wanted = wanted.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "table_id")
    return wanted.groupBy("table_id").applyInArrow(run, OUT)


def from_json(text: str) -> Condition:
    """A condition from the ``condition`` column."""
    raw = json.loads(text)

    def side(e):
        constant = None if e["constant"] is None else tuple(e["constant"])
        return Expression(e["select"], e["column"], tuple(Filter(**f) for f in e["filters"]), constant)

    return Condition(side(raw["left"]), raw["compare"], side(raw["right"]))
