"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pytest

import __spark_entry__
from quarry.plans.fixtures import TABLES
from quarry.plans.registry import QUERIES, SQL

__spark_entry__.queries()  # registers all


def plain(v):
    if isinstance(v, float) and v == int(v):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(names, want.fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
