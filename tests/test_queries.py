"""Every query that has SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import datetime
import math

import duckdb
import pytest
from quillgraph.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(x) for x in r]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
