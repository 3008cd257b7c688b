"""Hulls of few points go to Python once, those of many in parts."""

from landfold.operators import frames


def test_hulls_are_made_once_and_small_ones_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(frames, "HULL_FEW", 20, raising=False)
    few = spark.range(4).selectExpr("1L AS k", "CAST(id % 2 * 3 AS DOUBLE) AS x", "CAST(floor(id / 2) * 3 AS DOUBLE) AS z")
    many = spark.range(60).selectExpr("2L AS k", "CAST(id AS DOUBLE) AS x", "CAST(id * (60 - id) AS DOUBLE) AS z")
    area = frames.hull_area(frames.convex_hull(few.unionByName(many), "k"), "k")
    assert "FlatMapGroupsInPandas" not in area._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["vertices"] for r in area.collect()} == {1: 4, 2: 60}
