"""Every query with SQL gives the rows that DuckDB gives over the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tarnwell.plans import registry

D = "/root/testdata/sf0.001"
SQL = registry.SQL  # entry has imported all modules of queries


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.4f}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    r = con.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(cols, row, strict=True))[c]) for c in sorted(cols)) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in sorted(cols)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(SQL)))
def test_without_sql_gives_rows(spark, name):
    """Their operators are compared with brute force elsewhere; here the whole query runs and has distinct columns."""
    few = name in ("bm25_rerank", "context_best_match")  # the smallest tables rightly give none
    df = registry.QUERIES[name](spark, D.replace("0.001", "0.01") if few else D)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "id", "score", "rank"]
