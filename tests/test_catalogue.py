"""Queries against their SQL on the smallest tables; the driver does the rest at a larger scale."""

import duckdb
import pytest

from landfold.catalogue import oracles, spark_queries
from landfold.views import BASE_TABLES

ROOT = "/root/testdata/sf0.001"
NAMES = ["d1_attribute_points", "d4_nearest_line", "d9_occluded_pairs", "d25_sample_dem_triangle", "e11_coverage", "e17_merge_intervals", "f6_rolling_quantiles",
         "g3_components", "h6_upsert_state", "t4_greedy_budget_shared", "k1_attribution_cascade", "s4_display_name"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = spark_queries()[name](spark, ROOT)
    cur = duck.execute(oracles()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    theirs = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == theirs


def test_every_oracle_belongs_to_a_query():
    assert set(oracles()) <= set(spark_queries())
