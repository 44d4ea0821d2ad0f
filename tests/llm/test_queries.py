"""The package's queries over the smallest tables: against SQL where there is some, else rows with distinct columns."""

import os

import duckdb
import pytest

from tarnwell.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(D):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    r = con.execute(queries.SQL[name])
    cols = [c[0] for c in r.description]
    want = sorted(tuple(str(x) for x in row) for row in r.fetchall())
    assert want and sorted(tuple(str(row[c]) for c in cols) for row in queries.QUERIES[name](spark, D).collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs_whole(spark, name):
    df = queries.QUERIES[name](spark, D)
    rows = df.count()
    assert len(set(df.columns)) == len(df.columns) and (rows > 0 or name in ("p6_found", "p9_found", "p10_found"))
