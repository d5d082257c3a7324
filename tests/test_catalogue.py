"""Every catalogue query against its SQL in DuckDB on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

from lantern.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
    return f"{float(value):.9g}"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in frame.collect())
    relation = duck.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in relation.fetchall())
    assert ours == theirs


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
