"""Steps whose cost per key or pair must stay small."""

from landfold.operators import bodies, frames, polygons


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_hulls_share_a_call_of_python(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(frames, "cut_lineage", lambda df, cut=frames.cut_lineage, **kw: seen.append(cut(df, **kw)) or seen[-1])
    points = spark.range(900).selectExpr("id % 300 AS k", "CAST(id * id % 7 AS DOUBLE) AS x", "CAST(id % 11 AS DOUBLE) AS z")
    hull = frames.convex_hull(points, "k")
    text = plan(hull)
    assert "ArrowEvalPython" in text
    sizes = {r["k"]: r["n"] for r in hull.groupBy("k").count().withColumnRenamed("count", "n").collect()}
    assert set(sizes) == set(range(300)) and max(sizes.values()) <= 3


def test_hulls_do_not_depend_on_how_they_are_made(spark, monkeypatch):
    points = spark.range(4000).selectExpr("id % 40 AS k", "CAST(id * 7919 % 101 AS DOUBLE) AS x", "CAST(id * 104729 % 97 AS DOUBLE) AS z")
    listed = sorted(map(tuple, frames.convex_hull(points, "k").collect()))
    monkeypatch.setattr(frames, "HULL_SMALL", 0)
    assert listed == sorted(map(tuple, frames.convex_hull(points, "k").collect()))


def test_distances_of_pairs_are_not_in_a_join(spark):
    edges = spark.createDataFrame([(p, 0, 0, i, *e) for p, x in ((1, 0.0), (2, 15.0), (3, 100.0), (4, 1.0)) for i, e in enumerate(
        [(x, 0.0, x + 5, 0.0), (x + 5, 0.0, x + 5, 5.0), (x + 5, 5.0, x, 5.0), (x, 5.0, x, 0.0)])], "poly_id long, part int, ring int, seq int, x1 double, z1 double, x2 double, z2 double")
    near = polygons.within_distance(edges, edges, 10.0, "a_id < b_id")
    assert max(len(line) for line in plan(near).splitlines() if "SortMergeJoin" in line) < 1500
    assert sorted(map(tuple, near.collect())) == [(1, 2), (1, 4), (2, 4)]


def test_parts_are_connected_by_runs_of_cells(spark, monkeypatch):
    met = []
    monkeypatch.setattr(bodies, "connected", lambda nodes, edges, go=bodies.connected: met.append(nodes.count()) or go(nodes, edges))
    # a square of 4 x 4 metres and one of 2 x 2 apart from it, each of two faces
    squares = [(f, x1, z1, x2, z2, x3, z3) for s, (x, w) in enumerate(((0.0, 4.0), (6.0, 2.0))) for f, x1, z1, x2, z2, x3, z3 in (
        (2 * s, x, 0.0, x + w, 0.0, x + w, w), (2 * s + 1, x, 0.0, x + w, w, x, w))]
    tri = spark.createDataFrame([(0, f, x1, 1.0, z1, x2, 1.0, z2, x3, 1.0, z3) for f, x1, z1, x2, z2, x3, z3 in squares],
                                "tile_id long, tri_idx long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double")
    row = bodies.slice_support(tri, "tile_id", 0.5, (0.0,), large=5.0).first()
    assert (row.cells, row.area, row.parts, row.large_parts, row.largest) == (80, 20.0, 2, 1, 16.0)
    assert met == [12]
