import json
import random

import pytest

from tablewright.operators import grammar
from tablewright.operators.grammar import Condition, Expression, Filter, Grid

GRID = {"City": ["Ulm", "Bonn", "Kiel", "Ulm"], "Size": ["3", "1,000", "7", "4"], "Note": ["x", "", "5", "x"]}


@pytest.mark.parametrize(
    "select, column, filters, values",
    [
        ("SUM", "Size", (), {"1014"}), ("AVERAGE", "Size", (("City", "EQUALS", "Ulm"),), {"3.50"}), ("RANGE", "Size", (("Size", "LESSER", "8"),), {"4"}),
        ("GREATEST", "Size", (), {"1,000"}), ("LOWEST", "Size", (), {"3"}), ("FIRST", "City", (), {"Ulm"}), ("LAST", "Note", (), {"x"}),
        ("NONE", "City", (("Size", "GREATER", "3"),), {"Bonn", "Kiel", "Ulm"}), ("COUNT", "", (("City", "EQUALS", "Ulm"),), {"2"}),
        ("COUNT", "", (("City", "EQUALS", "Rom"),), None), ("SUM", "City", (), None), ("SUM", "Size", (("City", "EQUALS", "Kiel"),), None),
        ("COUNT", "", (("City", "GREATER", "3"),), None), ("COUNT", "", (("Size", "GREATER", "few"),), None),
    ],
)
def test_expressions(select, column, filters, values):
    assert Grid(GRID).values(Expression(select, column, tuple(Filter(*f) for f in filters))) == values


def test_words_and_comparisons():
    c = Condition(Expression("RANGE", "Size", (Filter("City", "EQUALS", "Ulm"), Filter("Size", "LESSER", "8"))), "GREATER", Expression(constant=("0",)))
    assert c.say() == "the range of Size when City is Ulm and Size is less than 8 is greater than 0"
    assert Grid(GRID).holds(c) is True and grammar.from_json(c.as_json()) == c
    one = lambda *x: frozenset(x)
    assert grammar.compared(one("1", "2"), "LESSER", one("3")) and grammar.compared(one("1", "4"), "LESSER", one("3")) is False
    assert grammar.compared(one("a"), "LESSER", one("3")) is None and grammar.compared(one("a"), "EQUALS", one("a")) and grammar.compared(one(), "GREATER", one("1")) is None


def test_statements_have_their_labels(spark):
    grids = {f"t{i}": {"City": [f"c{(i * j) % 5}" for j in range(6)], "Size": [str((i * 7 + j * j) % 11) for j in range(6)]} for i in range(12)}
    rows = [(t, j, name, x) for t, g in grids.items() for name, xs in g.items() for j, x in enumerate(xs)]
    odd = [("one row", 0, "A", "1"), ("nulls", 0, "A", None), ("nulls", 1, "A", None), ("twice", 0, "A", "1"), ("twice", 0, "A", "2"), (None, 0, "A", "1"), (None, 1, "A", "2")]
    cells = spark.createDataFrame(rows + odd, "table_id string, row_index int, column_name string, text string")
    got = grammar.statements(cells).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, grammar.statements(cells.repartition(3)).collect()))
    met = {r["table_id"] for r in got}
    assert set(grids) <= met and not met & {"one row", "twice", None}
    for t in grids:
        assert sorted((r["label"], r["shuffled"] is None) for r in got if r["table_id"] == t) == [(0, False), (0, True), (1, False), (1, True)]
    for r in (r for r in got if r["table_id"] in grids):
        texts = dict(grids[r["table_id"]])
        if r["shuffled_column"]:
            assert sorted(r["shuffled"]) == sorted(texts[r["shuffled_column"]])
            texts[r["shuffled_column"]] = r["shuffled"]
        assert plain(json.loads(r["condition"]), texts) == bool(r["label"])
    assert {r["shuffled"] for r in grammar.statements(cells, opposite=False).collect()} == {None}
    assert grammar.statements(cells.limit(0)).count() == 0


def plain(c, texts):
    """The condition row by row, in plain Python."""

    def side(e):
        if e["constant"] is not None:
            return set(e["constant"])
        rows = [dict(zip(texts, xs)) for xs in zip(*texts.values())]
        for f in e["filters"]:
            test = {"EQUALS": lambda r: r[f["column"]] == f["value"], "LESSER": lambda r: float(r[f["column"]]) < float(f["value"]), "GREATER": lambda r: float(r[f["column"]]) > float(f["value"])}[f["compare"]]
            rows = [r for r in rows if test(r)]
        xs = [r.get(e["column"]) for r in rows]
        by = {"COUNT": lambda: {str(len(rows))}, "NONE": lambda: set(xs), "FIRST": lambda: {xs[0]}, "LAST": lambda: {xs[-1]}, "LOWEST": lambda: {min(xs, key=float)}, "GREATEST": lambda: {max(xs, key=float)}}
        if e["select"] in by:
            return by[e["select"]]()
        ns = [float(x) for x in xs]
        return {grammar.shown({"SUM": sum(ns), "RANGE": max(ns) - min(ns), "AVERAGE": sum(ns) / len(ns)}[e["select"]])}

    a, b = side(c["left"]), side(c["right"])
    if c["compare"] == "EQUALS":
        return a == b
    a, b = [float(x) for x in a], [float(x) for x in b]
    return max(a) < min(b) if c["compare"] == "LESSER" else min(a) > max(b)


NUMBERS = ["1,5", "1st", "-inf", "1,000", "1.000.000", "1,2,3", "1.5e3", " 7 ", "", "nan", "1_000", "+3", "1,234.5", "--1", "12,3456", "0x1", "١", "1e400", ".5", "5.", "a"]


def test_one_reader_of_numbers(spark):
    """The grammar, its statements and the library's queries read the same texts as numbers, and as the same ones."""
    from pyspark.sql import functions as F

    from tablewright.functions import numbers

    df = spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i int, x string")
    wide = [r[0] for r in df.orderBy("i").select(numbers.to_float("x")).collect()]
    near = [numbers.read_float(x) for x in NUMBERS]
    assert list(map(repr, wide)) == list(map(repr, near)) and near[:4] == [1.5, None, float("-inf"), 1000.0] and numbers.read_float(None) is None
    from tablewright.operators import query

    for bound in ("1,5", "2", "1,000"):
        for compare, sign in (("GREATER", ">"), ("LESSER", "<")):
            good = [x for x, v in zip(NUMBERS, near) if v is not None and v == v]
            said = Grid({"x": good, "one": ["1"] * len(good)}).values(Expression("COUNT", "", (Filter("x", compare, bound),)))
            asked = query.where_number(spark.createDataFrame([(x,) for x in good], "x string"), "x", sign, numbers.read_float(bound)).count()
            assert said == (frozenset([str(asked)]) if asked else None), (bound, compare)


def test_draws_are_those_of_the_random_module():
    """Cheaper draws leave the statements as they were."""
    for n in (1, 2, 3, 8, 40):
        a, b, items = random.Random(f"{n}"), random.Random(f"{n}"), [f"x{i}" for i in range(n)]
        assert grammar._order(a, items) == b.sample(items, n) and grammar._any(a, items) == b.choice(items)
    grid = grammar.Grid({"n": [str(i * 7 % 10) for i in range(10)], "t": list("abcabcabca")})
    assert isinstance(grid.numbers["n"], list) and isinstance(grid.texts["t"], list)  # no array's fixed costs in a draw
    assert grid.values(grammar.Expression("LOWEST", "n", (grammar.Filter("t", "EQUALS", "b"),))) == {"7"}
