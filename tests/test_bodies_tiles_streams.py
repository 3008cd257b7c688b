"""Clipped faces, interfaces, clearances, exported tiles and late stream rows against hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from landfold.operators import bodies, raster
from landfold.sources import releases
from landfold.streaming import runs

TRI = "tile_id bigint, tri_idx bigint, " + ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xyz")


def test_clipping_leaves_three_or_four_vertices(spark):
    tri = spark.createDataFrame([(0, 0, 0., 0., 0., 4., 0., 0., 0., 4., 4.), (0, 1, 0., 0., 0., 4., 4., 0., 0., 4., 4.), (0, 2, 0., 9., 0., 4., 9., 0., 0., 9., 4.), (0, 3, 0., 0., 0., 1., 0., 0., 0., 1., 1.), (0, 4, 0., 2., 0., 1., 2., 0., 2., 2., 0.)], TRI)
    got = {r.tri_idx: (len(r.polygon), r.plan_area) for r in bodies.clip_above(tri.withColumn("cut", F.lit(2.0)), "cut").collect()}
    # the part above the cut: a quarter, three quarters, the whole; below and edge-on there is nothing
    assert got == {0: (3, 2.0), 1: (4, 6.0), 2: (3, 8.0)}
    assert bodies.fan(bodies.clip_above(tri.withColumn("cut", F.lit(2.0)), "cut")).count() == 4


def test_support_counts_parts(spark):
    def roof(i, x, y):  # two faces of a square of side 4
        return [(7, 2 * i, x, y, 0., x + 4, y, 0., x, y, 4.), (7, 2 * i + 1, x + 4, y, 0., x + 4, y, 4., x, y, 4.)]

    tri = spark.createDataFrame(roof(0, 0.0, 0.0) + roof(1, 10.0, 8.0) + roof(2, 14.0, 8.0) + roof(3, 30.0, 8.0), TRI)
    rows = {r.slice: r for r in bodies.slice_support(tri, "tile_id", 0.5, (0.0, 0.5)).collect()}
    assert (rows[0.0].area, rows[0.0].parts, rows[0.0].faces, rows[0.0].clipped_area) == (64.0, 3, 8, 64.0)
    assert (rows[0.5].area, rows[0.5].parts, rows[0.5].large_parts, rows[0.5].largest, rows[0.5].cut_y) == (48.0, 2, 2, 32.0, 4.0)


def test_nearest_cells_equal_brute_force(spark):
    rng = random.Random(3)
    cells = [(k, rng.randrange(-300, 300), rng.randrange(-300, 300)) for k in (1, 2) for _ in range(60)]
    points = [(k, rng.randrange(-300, 300), rng.randrange(-300, 300)) for k in (1, 2, 3) for _ in range(40)] + cells[:5]
    schema = "k int, row_no bigint, col_no bigint"
    got = {(r.k, r.row_no, r.col_no): r.d2 for r in bodies.nearest_cells(spark.createDataFrame(points, schema), spark.createDataFrame(cells, schema), "k").collect()}
    assert got == {p: min((p[1] - c[1]) ** 2 + (p[2] - c[2]) ** 2 for c in cells if c[0] == p[0]) for p in points if p[0] != 3}


def test_interface_of_a_tower_on_a_podium(spark):
    podium = [("a", r, c, 5.0) for r in range(4) for c in range(4)] + [("a", 9, 9, 1.0)]
    tower = [("b", r, c, 5.0) for r in (1, 2) for c in (1, 2)] + [("b", 1, 7, 5.0), ("b", 2, 2, 30.0)]
    cells = spark.createDataFrame(podium + [t for t in tower if t != ("b", 2, 2, 5.0)], "body string, row_no bigint, col_no bigint, y double")
    edges = spark.createDataFrame([(1, 0, 0, i, *e) for i, e in enumerate([(0., 0., 8., 0.), (8., 0., 8., 8.), (8., 8., 0., 8.), (0., 8., 0., 0.)])],
                                  "poly_id bigint, part int, ring int, seq int, x1 double, z1 double, x2 double, z2 double")
    (r,) = bodies.interfaces(cells, spark.createDataFrame([("a", "b")], "a string, b string"), 2.0, edges).collect()
    assert (r.level_step, r.shared_area, r.only_a, r.only_b, r.foot_cells, r.contact_area) == (0.0, 16.0, 52.0, 4.0, 4, 12.0)
    assert (r.distance_min, r.distance_median, r.distance_max, r.outside_area) == (0.0, 0.0, 8.0, 4.0)
    assert r.distance_p95 == pytest.approx(0.85 * 8.0)


def test_clearance_falls_past_its_own_faces(spark):
    face = lambda i, y, x=0.0: (0, i, x, y, 0., x + 3, y, 0., x, y, 3.)
    tri = spark.createDataFrame([(*face(0, 20.0), 5), (*face(1, 15.0), 5), (*face(2, 4.0), 6), (*face(3, 1.0), 6), (*face(4, 9.0, 50.0), 7)], TRI + ", component bigint")
    got = {r.component: (r.separation, r.gap_below, r.samples, r.open_samples) for r in bodies.clearance(tri, 30.0).collect()}
    assert got[5] == (11.0, pytest.approx(10.99), 2, 0) and got[6] == (11.0, None, 2, 2) and got[7] == (None, None, 1, 1)


def test_tiles_round_trip_and_each_fault(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, None if r < 4 and c < 4 else float(r * 10 + c)) for r in range(8) for c in range(8)], "row_no bigint, col_no bigint, h double")
    tiles = releases.export_tiles(raster.tile_grid(cells, n=4), f"{tmp_path}/tiles")
    assert sorted({(r.tile_row, r.tile_col) for r in tiles.select("tile_row", "tile_col").collect()}) == [(0, 1), (1, 0), (1, 1)]
    assert raster.tile_violations(tiles, cells, n=4).count() == 0
    held = (F.col("row_no") == 5) & (F.col("col_no") == 4)
    bad = tiles.where(~(held & F.col("core"))).withColumns({
        "h": F.when((F.col("row_no") == 7) & (F.col("col_no") == 7), 0.0).when((F.col("row_no") == 6) & (F.col("col_no") == 6), None).otherwise(F.col("h")),
        "row_no": F.when((F.col("row_no") == 6) & (F.col("col_no") == 1), 60).when((F.col("row_no") == 7) & (F.col("col_no") == 1), 0).otherwise(F.col("row_no"))})
    got = {(r.rule, r.row_no, r.col_no) for r in raster.tile_violations(bad, cells, n=4).collect()}
    assert {("cell-differs", 7, 7), ("no-data-differs", 6, 6), ("outside-grid", 60, 1), ("not-in-tile", 0, 1), ("cell-missing", 5, 4), ("cell-missing", 6, 1), ("cell-missing", 7, 1)} <= got


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """The second file comes a day later, the last one goes back: its row of the first day is late, and one repeats."""
    def put(k, rows):
        spark.createDataFrame(rows, "path string, sha256 string, bytes bigint, at string").select("path", "sha256", "bytes", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")

    good = "a" * 64
    put(0, [("../x", good, 1, "2024-01-01 00:00:00"), ("../x", good, 1, "2024-01-01 00:00:05"), ("ok", good, 1, "2024-01-01 00:00:00"), ("ok", "short", -1, "2024-01-01 00:00:00")])
    put(1, [("../y", good, 1, "2024-01-02 00:00:00")])
    put(2, [("../w", good, 1, "2024-01-02 00:01:00")])
    put(3, [("../z", good, 1, "2024-01-01 00:00:01"), ("../w", good, 1, "2024-01-02 00:01:00")])
    schema = spark.read.parquet(f"{tmp_path}/in/f0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    rows, late = runs.run_counted(runs.check_assets(stream))
    assert sorted((r.path, r.rule) for r in rows.collect()) == [("../w", "bad-path"), ("../x", "bad-path"), ("../y", "bad-path"), ("ok", "bad-sha256"), ("ok", "bad-size")]
    assert late == 1
