"""Registered queries against their SQL on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from logspark import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


def test_every_query_has_sql():
    assert set(catalog.SQL) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
