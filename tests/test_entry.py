"""The registry, and every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import TABLES, rows

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    df = entry.catalog.queries()[name](spark, D)
    got, want = df.toPandas(), con.execute(entry.catalog.oracle_sql()[name]).df()
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
