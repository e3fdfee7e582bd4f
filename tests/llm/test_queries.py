"""Properties of whole tables against SQL, on the smallest tables."""

import duckdb
import pytest

from graphloom.llm import queries
from tools_compare import TABLES, rows

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, D).toPandas(), con.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
