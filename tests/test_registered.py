"""Registered queries of the engine run on the smallest tables, with the columns and rows that their SQL has: those that
the bench times and those without SQL, or all with QUARRY_ALL=1 (twelve minutes)."""

import os

import bench
import duckdb
import pytest

import __spark_entry__
from quarry.operators import store

QUERIES = {k: f for p in __spark_entry__._PLANS for k, f in p.QUERIES.items()}
SQL = {k: q for p in __spark_entry__._PLANS for k, q in p.ORACLE.items()}
SOME = sorted(k for k in QUERIES if k in bench.HEADLINE or k not in SQL or os.environ.get("QUARRY_ALL"))


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for name in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
                 "clicks sales sale_lines clients client_changes vendors items stamps").split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_runs(spark, sf, views, name):
    got = QUERIES[name](spark, sf)
    rows = got.count()
    if name in SQL:
        want = views.execute(SQL[name])
        assert sorted(c[0] for c in want.description) == sorted(got.columns)
        assert len(want.fetchall()) == rows
    store.forget(spark)
