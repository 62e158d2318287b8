"""Every registered query against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, differences  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_rows_as_sql(name, spark, duck):
    assert differences(queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df()) == []


@pytest.mark.parametrize("name", [n for n in queries() if n not in oracle_sql()])
def test_rows_without_sql(name, spark):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 1000
