"""Sides of joins whose rows were multiplied by an explode are not broadcast, however small Spark takes them to be."""

import re

import pytest

from landfold import catalogue
from landfold.operators import bodies

DATA = "/root/testdata/sf0.001"


def broadcast_keys(df) -> set[str]:
    """The first keys of all broadcast joins of a plan, without their numbers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#.*", "", key) for key in re.findall(r"BroadcastHashJoin \[([^,\]]*)", plan)}


@pytest.mark.parametrize(("name", "key"), [
    ("d10_overlap_match", "row_no"),
    ("e29_hit_histogram", "lvl"),
    ("f2_first_hits", "lvl"),
    ("k13_identity_audit", "row_no"),
    ("k5_floater_audit", "tri_idx"),
    ("t9_line_view_score", "lvl"),
    ("d8_ray_hits", "lvl"),
    ("e11_coverage", "row_no"),
    ("f3_before_blocker", "lvl"),
    ("f4_specific_hit", "lvl"),
    ("k7_viewport_audit", "lvl"),
])
def test_multiplied_sides_are_not_broadcast(spark, name, key):
    assert key not in broadcast_keys(catalogue.spark_queries()[name](spark, DATA))


def test_cells_of_a_pair_are_not_broadcast(spark, monkeypatch):
    met = set()
    monkeypatch.setattr(bodies, "cut_lineage", lambda df, cut=bodies.cut_lineage, **kw: met.update(broadcast_keys(df)) or cut(df, **kw))
    cells = spark.range(4).selectExpr("'p' AS pair", "id * 5 AS row_no", "id AS col_no")
    points = spark.range(4).selectExpr("'p' AS pair", "id * 5 + 2 AS row_no", "id AS col_no")
    got = sorted(tuple(r) for r in bodies.nearest_cells(points, cells, "pair").select("row_no", "d2").collect())
    assert got == [(2, 4), (7, 4), (12, 4), (17, 4)]
    assert not [k for k in met if k in ("r", "c", "row_no")] and len([k for k in met if k == "pair"]) <= 1


def test_arithmetic_of_rays_is_not_repeated_in_filters(spark):
    plan = catalogue.spark_queries()["d8_ray_hits"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("*") for line in plan.splitlines() if "Filter" in line or "Join" in line) < 40
