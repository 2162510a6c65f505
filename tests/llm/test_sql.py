"""Queries that SQL can express, against it; and every query on tables without rows."""

import duckdb
import pytest

from mediacairn.llm.queries import CHECKS, QUERIES
from tools.check import TABLES, compare

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, name, SF, QUERIES, CHECKS)
    assert ok, text


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bare")
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_rows(spark, bare, name):
    assert QUERIES[name](spark, bare).count() == 0
