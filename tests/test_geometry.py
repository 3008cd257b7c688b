"""Hand-made geometry: boundaries, holes, sight lines, rays."""

import math

from pyspark.sql import functions as F

from landfold.functions import codecs, geometry as g
from landfold.operators import frames, mesh, occlusion, polygons, raster


def ring(poly, ring_no, pts, part=0):
    return [(poly, part, ring_no, i, float(x), float(z), float(pts[(i + 1) % len(pts)][0]), float(pts[(i + 1) % len(pts)][1])) for i, (x, z) in enumerate(pts)]


EDGES = "poly_id long, part int, ring int, seq int, x1 double, z1 double, x2 double, z2 double"
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6)]


def edges(spark, *rings):
    return spark.createDataFrame([r for one in rings for r in one], EDGES)


def test_boundary_policies(spark):
    e = edges(spark, ring(1, 0, SQUARE), ring(1, 1, HOLE))
    where = {"inside": (1, 1), "vertex": (0, 0), "edge": (5, 0), "hole": (5, 5), "hole_edge": (4, 5), "out": (11, 5)}
    pts = spark.createDataFrame([(k, float(x), float(z)) for k, (x, z) in where.items()], "pt_id string, x double, z double")
    got = {m: {r.pt_id for r in polygons.point_in_polygon(pts, e, m).collect()} for m in ("exclude", "include_outer", "include_all")}
    assert got["exclude"] == {"inside"}
    assert got["include_outer"] == {"inside", "vertex", "edge"}
    assert got["include_all"] == {"inside", "vertex", "edge", "hole_edge"}


def test_two_parts_and_tolerance(spark):
    e = edges(spark, ring(1, 0, SQUARE), ring(1, 0, [(20, 0), (30, 0), (30, 10), (20, 10)], part=1))
    pts = spark.createDataFrame([(1, 25.0, 5.0), (2, 15.0, 5.0), (3, 10.1, 5.0), (4, 10.2, 5.0)], "pt_id long, x double, z double")
    assert {r.pt_id for r in polygons.point_in_polygon(pts, e).collect()} == {1}
    assert {r.pt_id for r in polygons.point_in_polygon_tolerant(pts, e, 0.15).collect()} == {1, 3}


def test_area_centroid_label(spark):
    e = edges(spark, ring(1, 0, SQUARE), ring(1, 1, HOLE), ring(2, 0, [(0, 0), (8, 0), (8, 1), (1, 1), (1, 8), (0, 8)]))
    a = {r.poly_id: r.net_area for r in polygons.poly_area(e).collect()}
    assert a == {1: 96.0, 2: 15.0}
    method = {r.poly_id: r.method for r in polygons.label_point(e).collect()}
    assert method == {1: "grid", 2: "grid"}
    inside = polygons.point_in_polygon(polygons.label_point(e).select(F.col("poly_id").alias("pt_id"), "x", "z"), e, "exclude")
    assert inside.where("pt_id = poly_id").count() == 2


def test_polygons_meet_and_near(spark):
    e = edges(spark, ring(1, 0, SQUARE), ring(2, 0, [(2, 2), (3, 2), (3, 3), (2, 3)]), ring(3, 0, [(10, 3), (14, 3), (14, 6), (10, 6)]), ring(4, 0, [(30, 0), (31, 0), (31, 1), (30, 1)]))
    meet = {(r.a_id, r.b_id) for r in polygons.poly_intersects(e, e, "a_id < b_id").collect()}
    assert meet == {(1, 2), (1, 3)}
    near = {(r.a_id, r.b_id) for r in polygons.within_distance(e, e, 16.5, "a_id < b_id").collect()}
    assert (3, 4) in near and (1, 4) not in near


def test_occlusion_cases(spark):
    e = edges(spark, ring(1, 0, SQUARE), ring(1, 1, HOLE))
    h = spark.createDataFrame([(1, 0.0, 5.0)], "poly_id long, min_y double, max_y double")
    cases = [("through", -5, 2, 2, 15, 2, 2, None), ("over", -5, 6, 2, 15, 6, 2, None), ("own", -5, 2, 2, 15, 2, 2, 1), ("tangent", -5, 2, 0, 15, 2, 0, None),
             ("yard", 4.5, 2, 5, 5.5, 2, 5, None), ("upright", 2, -3, 2, 2, 9, 2, None), ("upright_yard", 5, -3, 5, 5, 9, 5, None)]
    p = spark.createDataFrame([(c[0], *map(float, c[1:7]), c[7]) for c in cases], "pair_id string, cx double, cy double, cz double, mx double, my double, mz double, own_id long")
    assert {r.pair_id for r in occlusion.occluded(p, e, h).collect()} == {"through", "upright"}
    flat = spark.createDataFrame([(1, 2.0, 2.0)], "poly_id long, min_y double, max_y double")
    assert occlusion.occluded(p, e, flat).count() == 0


def test_convex_hull_against_brute_force(spark):
    rows = [("a", float((i * 37) % 101), float((i * 53) % 97)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x double, z double")
    hull = frames.convex_hull(df, "k").orderBy("seq").collect()
    assert hull == frames.convex_hull(df, "k", parts=3).orderBy("seq").collect()
    v = [(r.x, r.z) for r in hull]
    for i, a in enumerate(v):
        b = v[(i + 1) % len(v)]
        assert all((b[0] - a[0]) * (z - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for _, x, z in rows)


def test_linearised_tile_is_close(spark):
    from landfold.functions.geodesy import geodetic_to_ecef

    t = spark.range(1).select(F.col("id").alias("tile_id"), F.lit(50.0).alias("radius"), *[c.alias(n) for n, c in zip(("ox", "oy", "oz"), geodetic_to_ecef(F.radians(F.lit(114.26)), F.radians(F.lit(22.33)), F.lit(80.0)))])
    assert frames.linearise(t, 844800.0, 820500.0).first()["max_error"] < 0.002


def test_mip_bytes_and_ramp(spark):
    r = spark.range(1).select(codecs.mip_bytes(F.lit(4), F.lit(2)).alias("m"), g.interp(F.lit(15.0), [20, 10], [0, 1]).alias("i")).first()
    assert r.m == 4 * (8 + 2 + 1) and math.isclose(r.i, 0.5)


def test_ray_meets_each_face_once(spark):
    tri = spark.createDataFrame([(0, i, 0.0, float(i), 0.0, 40.0, float(i), 0.0, 0.0, float(i), 40.0) for i in range(3)], "tile_id int, tri_idx long, " + ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xyz"))
    rays = spark.createDataFrame([(7, 5.0, 60.0, 5.0, 0.0, -1.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    hits = mesh.ray_hits(rays, tri, 80.0).orderBy("dist").collect()
    assert [(h.tri_idx, h.dist) for h in hits] == [(2, 58.0), (1, 59.0), (0, 60.0)]
    assert raster.triangles_to_cells(tri.where("tri_idx=0"), 8.0).count() == 15


def test_rings_of_real_coordinates_are_closed(spark):
    import math
    import random

    rnd = random.Random(1)
    rings = [ring(i, 0, [(rnd.uniform(-1e5, 1e5) + 3 * math.cos(k / 3), rnd.uniform(-1e5, 1e5) / 3 + math.sin(k / 3)) for k in range(12)]) for i in range(50)]
    two_gaps = [(99, 0, 0, 0, 0.0, 0.0, 1.0, 0.0), (99, 0, 0, 1, 1.0, 0.1, 0.0, 1.0), (99, 0, 0, 2, 0.0, 0.9, 0.0, 0.0)]
    flat = ring(98, 0, [(0.1, 0.3), (0.2, 0.6), (0.3, 0.9)])
    got = {(r.poly_id, r.rule) for r in polygons.geometry_violations(spark.createDataFrame([e for one in [*rings, two_gaps, flat] for e in one], EDGES)).collect()}
    assert got == {(99, "open-ring"), (98, "zero-area")}
