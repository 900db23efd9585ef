"""The problems' queries that have SQL, over the smallest test tables."""

import os

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.queries()[name](spark, DATA)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect())
    assert mine == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
