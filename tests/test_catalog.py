"""Every query with SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import catalog

DATA = "/root/testdata/sf0.001"
CORE = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = CORE[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
