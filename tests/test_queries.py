"""Every registered query against its check SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from mediacairn.plans.registry import QUERIES
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, name, SF, entry.queries(), entry.oracle_sql())
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() == 100
