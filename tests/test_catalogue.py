"""Every query of the catalogue with SQL gives the rows of its SQL; the entry runs."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from retrace import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted([plain(v) for v in r] for r in got.select(*columns).collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted([plain(r[i]) for i in order] for r in duck.execute(catalogue.ORACLE_SQL[name]).fetchall())


def test_without_sql(spark, sf):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        found = catalogue.QUERIES[name](spark, sf).limit(5).collect()
        assert found, name


def test_daily_histogram_reads_all(spark, sf):
    days = catalogue.QUERIES["agg_date_histogram_day_all"](spark, sf).collect()
    assert sum(r["doc_count"] for r in days) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["day", "actor", "records"]
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
