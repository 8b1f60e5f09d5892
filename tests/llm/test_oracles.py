"""Queries with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from codeloom.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())
