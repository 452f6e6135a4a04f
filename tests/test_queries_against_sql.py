"""Every registered query of the wiki engine against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import scriptorium.plans  # noqa: F401
from scriptorium.registry import ORACLE_SQL, QUERIES


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 9) if isinstance(value, (int, float)) else str(value)


def _rows(frame):
    cols = sorted(frame.columns)
    values = frame[cols].astype(object).values.tolist()
    return cols, sorted([[_plain(v) for v in row] for row in values], key=str)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(name, spark, folder, duck):
    mine = _rows(QUERIES[name](spark, folder).toPandas())
    theirs = _rows(duck.sql(ORACLE_SQL[name]).df())
    assert mine == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
