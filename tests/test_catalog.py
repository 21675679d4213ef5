"""Every catalogue query against its SQL in DuckDB at the smallest scale."""

import duckdb
import pytest

from tablewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = sorted(map(repr, map(tuple, df.collect())))
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
