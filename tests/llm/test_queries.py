"""Queries of this subpackage on the smallest tables, against their SQL where there is one."""

import os

import pytest

from ledgerloom.llm import queries, sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = {tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()}
    if name in sql.SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f[:-8]} AS FROM read_parquet('{DATA}/{f}')")
        assert rows == {tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({sql.SQL[name]})").fetchall()}
