"""Queries that had bounds before compute every row of their table."""

import duckdb
import pandas as pd
import pytest

from scriptorium.plans import aggregate_queries, text_queries  # noqa: F401
from scriptorium.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
MATH = ["arithmetic", "power_unary", "logic", "division_by_zero", "functions", "round_half_up", "constants", "roots", "circular"]


def tables():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return frame.round(9).sort_values([c for c in ("page_id", "l_orderkey", "l_linenumber", "axis_key", "ord") if c in frame.columns], ignore_index=True)


@pytest.mark.parametrize("name", [f"mx_{m}" for m in MATH])
def test_expressions_over_every_line(spark, name):
    con = tables()
    mine = rows(QUERIES[name](spark, SF).toPandas())
    assert len(mine) == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    pd.testing.assert_frame_equal(mine, rows(con.sql(ORACLE_SQL[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", ["ag_axis_rating", "dt_include_expansion", "dt_include_edges", "it_source_expansion"])
def test_every_page(spark, name):
    con = tables()
    mine = rows(QUERIES[name](spark, SF).toPandas())
    assert mine["page_id"].nunique() == con.sql("SELECT count(*) FROM orders").fetchall()[0][0]
    pd.testing.assert_frame_equal(mine, rows(con.sql(ORACLE_SQL[name]).df()), check_dtype=False)
