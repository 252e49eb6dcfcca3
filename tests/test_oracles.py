"""Every query against its SQL oracle on the smallest data set."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as spark_entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


ORACLES = spark_entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF)
    mine = _rows(df.columns, df.collect())
    assert mine, "a query without rows shows nothing"
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert mine == _rows(columns, result.fetchall())


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 1


def test_known_plan_totals(spark):
    """Totals agreed for the source and destination of the 1:100 data set."""
    row = spark_entry.queries()["plan_summary"](spark, "/root/testdata/sf0.01").first()
    assert (row.skipped_files, row.conflicts, row.deleted_files) == (7500, 1500, 300)
    assert (row.updated_files, row.new_files) == (4500, 1500)
    assert row.bytes_to_delete == 148_040
    assert row.bytes_to_copy == 7_638_990_326_950 + 747_019
