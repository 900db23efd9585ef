"""Every query that has SQL gives the same rows in DuckDB, over the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import core_problems, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = queries.queries() | core_problems.queries()
SQL = queries.oracle_sql() | core_problems.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted(tuple(shown(r[c]) for c in sorted(names)) for r in df.collect())
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
