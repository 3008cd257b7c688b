"""Hand cases of the strict frontier, shared envelopes, the pick cascade, the registry rules and the road corridors."""

import math

import pytest
from pyspark.sql import functions as F

from landfold.operators import attribution, audits, hierarchy, registry, roads

NODES = "node_id bigint, parent_id bigint, available boolean, error double"


def cut(spark, rows, *args):
    return {r.node_id: (r.owner_id, r.failing_id, r.reason) for r in hierarchy.complete_frontier(spark.createDataFrame(rows, NODES), *args).collect()}


def test_missing_inner_node_breaks_the_leaves_below(spark):
    rows = [(1, None, True, 8.0), (2, 1, False, 4.0), (3, 1, True, 4.0), (4, 2, True, 0.0), (5, 2, True, 0.0), (6, 3, True, 0.0), (7, 3, False, 0.0), (8, 3, True, 2.0)]
    assert cut(spark, rows, 0.0, 1) == {4: (2, 2, "missing-ancestor"), 5: (2, 2, "missing-ancestor"), 6: (3, None, None), 7: (3, 7, "missing-node"), 8: (3, 8, "coarse-leaf")}
    owners = {r.owner_id: (r.nodes, r.failed, r.complete, r.first_failing) for r in hierarchy.frontier_owners(hierarchy.complete_frontier(spark.createDataFrame(rows, NODES), 0.0, 1)).collect()}
    assert owners == {2: (2, 2, False, 2), 3: (3, 2, False, 7)}


def test_dangling_and_cyclic_branches_are_told(spark):
    rows = [(1, None, True, 0.0), (5, 99, True, 4.0), (6, 5, True, 0.0), (10, 11, True, 0.0), (11, 10, True, 0.0), (12, 11, True, 0.0)]
    assert cut(spark, rows) == {1: (None, None, None), 6: (None, 99, "dangling-ancestor"), 12: (None, None, "cycle")}
    assert cut(spark, []) == {}


def test_threshold_ends_a_branch_at_the_first_fine_available_node(spark):
    rows = [(1, None, True, 8.0), (2, 1, True, 2.0), (3, 1, False, 2.0), (4, 2, True, 1.0), (5, 3, True, 1.0), (6, 3, True, 4.0), (7, 6, False, 0.0)]
    assert cut(spark, rows, 2.0, 0) == {2: (1, None, None), 5: (1, 3, "missing-ancestor"), 7: (1, 3, "missing-ancestor")}


def test_stage_violations_name_each_fault(spark):
    nodes = spark.createDataFrame([(1, None, True, 4.0), (2, 1, True, 0.0), (3, 1, True, 0.0), (4, 1, False, 0.0)], NODES)
    staged = spark.createDataFrame([(2,), (2,), (9,), (4,)], "node_id bigint")
    planned = spark.createDataFrame([(1, 2), (8, 1)], "owner_id bigint, leaves bigint")
    got = sorted((r.rule, r.key) for r in hierarchy.stage_violations(nodes, staged, planned, 0).collect())
    assert got == [("frontier-missing-node", 4), ("leaf-not-staged", 3), ("owner-leaf-count", 1), ("owner-leaf-count", 8), ("staged-outside-frontier", 9), ("staged-twice", 2)]


def square(poly, x0, z0, x1, z1, ring=0):
    c = [(x0, z0), (x1, z0), (x1, z1), (x0, z1)]
    return [(poly, 0, ring, i, float(c[i][0]), float(c[i][1]), float(c[(i + 1) % 4][0]), float(c[(i + 1) % 4][1])) for i in range(4)]


EDGES = "poly_id bigint, part int, ring int, seq int, x1 double, z1 double, x2 double, z2 double"


def test_shared_envelope_leaves_one_owner(spark):
    edges = spark.createDataFrame(square(1, 0, 0, 10, 10) + square(2, 5, 0, 15, 10) + square(3, 0, 20, 10, 30) + square(4, 0, 20, 10, 30) + square(5, 40, 0, 50, 10) + square(5, 44, 4, 46, 6, 1), EDGES)
    domains = spark.createDataFrame([(1, "tower", 0.0, None, "hall"), (2, "hall", 0.0, None, None), (3, "a", 0.0, None, "b"), (4, "b", 0.0, None, "a"), (5, "c", 0.0, 0.5, "nobody")],
                                    "poly_id bigint, entity_id string, min_y double, tolerance double, shared_with string")
    pts = spark.createDataFrame([(1, 7.0, 5.0, 1.0), (2, 12.0, 5.0, 1.0), (3, 5.0, 25.0, 1.0), (4, 50.4, 5.0, 1.0), (5, 50.6, 5.0, 1.0), (6, 45.0, 5.0, 1.0), (7, 7.0, 5.0, -1.0), (8, 10.3, 5.0, 1.0)],
                                "pt_id bigint, x double, z double, y double")
    got = {r.pt_id: (r.entity_id, r.method) for r in attribution.attribute_points(pts, edges, domains).collect()}
    one, none = "source-footprint-and-height", "unassigned"
    assert got == {1: ("tower", one), 2: ("hall", one), 3: ("a", one), 4: ("c", one), 5: (None, none), 6: (None, none), 7: (None, none), 8: ("hall", one)}
    plain = {r.pt_id: r.method for r in attribution.attribute_points(pts, edges, domains.drop("shared_with", "tolerance")).collect()}
    assert plain[1] == plain[3] == "ambiguous-source-footprints" and plain[4] == none


def test_each_rule_of_the_cascade(spark):
    edges = spark.createDataFrame(sum((square(i, 20 * i, 0, 20 * i + 10, 10) for i in range(1, 7)), []) + square(7, 62, 2, 66, 6) + square(8, 100, 0, 110, 10), EDGES)
    none = [None] * 2
    domains = [(1, "assoc", "association", 0.0, 9.0, *none), (2, "foot", "footprint", 0.0, 9.0, *none), (3, "field", "surface", 0.0, 0.0, *none), (7, "pitch", "surface", 0.0, 0.0, *none),
               (4, "range", "range", 0.0, 9.0, *none), (5, "twin1", "footprint", 0.0, 9.0, *none), (8, "twin2", "footprint", 0.0, 9.0, *none), (6, "far", "range", 0.0, 1.0, *none)]
    domains = spark.createDataFrame(domains, "poly_id bigint, entity_id string, kind string, min_y double, max_y double, tolerance double, shared_with string")
    domains = domains.withColumns({"roles": F.array(F.lit("baseline")), "source_object_ids": F.array(F.lit(7).cast("bigint"))})
    rows = [  # pt_id, x, z, y, ny, explicit, role, object, preserved
        (1, 25.0, 5.0, 5.0, 0.0, "given", "baseline", None, None), (2, 25.0, 5.0, 5.0, 0.0, None, "baseline", None, None), (3, 25.0, 5.0, 5.0, 0.0, None, "exterior", None, None),
        (4, 45.0, 5.0, 5.0, 0.0, None, "exterior", None, None), (5, 45.0, 5.0, 0.5, 1.0, None, "exterior", None, None), (6, 64.0, 4.0, 1.5, 1.0, None, "exterior", None, None),
        (7, 69.0, 9.0, 1.9, 1.0, None, "exterior", None, None), (8, 85.0, 5.0, 5.0, 0.0, None, "exterior", None, None), (9, 85.0, 5.0, 5.0, 0.0, None, "exterior", 7, None),
        (10, 85.0, 5.0, 5.0, 0.0, None, "photogrammetry", 8, None), (11, 85.0, 5.0, 5.0, 0.0, None, "photogrammetry", None, None), (12, 105.0, 5.0, 5.0, 0.0, None, "exterior", None, None),
        (13, 125.0, 5.0, 5.0, 0.0, None, "baseline", None, None), (14, 45.0, 5.0, 8.0, 1.0, None, "exterior", None, True), (15, 150.0, 2.0, 1.5, 1.0, None, "exterior", None, None),
        (16, 150.0, 2.0, 2.5, 1.0, None, "exterior", None, None)]
    pts = spark.createDataFrame(rows, "pt_id bigint, x double, z double, y double, ny double, explicit_id string, role string, source_object_id bigint, preserved boolean")
    ground = pts.select("pt_id", F.lit(0.0).alias("ground"))
    line = spark.createDataFrame([("road", 1, 0, 140.0, 0.0, 160.0, 0.0, True)], "entity_id string, line_id bigint, seq bigint, x1 double, z1 double, x2 double, z2 double, show_ground boolean")
    got = {r.pt_id: (r.entity_id, r.method) for r in audits.attribute_cascade(pts, ground, edges, domains, line).collect()}
    seen, rng = "unassigned-visible-surface", "source-range-footprint-and-height"
    assert got == {
        1: ("given", "explicit-source-owner"), 2: ("assoc", "local-source-representation-association"), 3: (None, seen), 4: ("foot", "source-footprint-and-height"), 5: (None, "unassigned-ground"),
        6: ("pitch", "source-outdoor-domain-near-ground"), 7: ("field", "source-outdoor-domain-near-ground"), 8: (None, seen), 9: ("range", rng), 10: (None, seen), 11: ("range", rng),
        12: (None, "ambiguous-source-footprints"), 13: (None, seen), 14: (None, "unassigned-ground"), 15: ("road", "source-road-near-ground"), 16: (None, seen)}


def test_foreground_hides_and_near_owners_come_first(spark):
    """Ray 1: an unassigned surface hides an owned one behind it; 2: a room just behind a floor; 3: a discarded hit is looked through; 4: an owner that is no entity is none."""
    hits = spark.createDataFrame(
        [(1, 1, 5.0, None), (2, 1, 6.0, "space:1"), (3, 2, 5.0, "floor:1"), (4, 2, 5.015, "space:1"), (5, 2, 5.5, "space:2"), (6, 3, 2.0, "floor:1"), (7, 3, 9.0, "space:2"), (8, 4, 1.0, "ghost")],
        "pt_id bigint, ray_id bigint, dist double, bound_id string").withColumns(
        {"x": F.when(F.col("pt_id") == 6, 100.0).otherwise(0.0), "y": F.lit(20.0), "z": F.lit(0.0), "ny": F.lit(0.0), "role": F.lit("exterior"), "source_object_id": F.lit(None).cast("bigint")})
    cells = spark.createDataFrame([(0, 0, 12, 255, 0, 0, 0)], "mask_id bigint, row_no bigint, col_no bigint, r int, g int, b int, a int")
    rules = spark.createDataFrame([("exterior", 0, 0.0, 40.0, False, False, 0.0)], "role string, mask_id bigint, min_y double, max_y double, replacement boolean, encoded boolean, clearance double")
    objects = spark.createDataFrame([], "source_object_id bigint, bundle_id string, role string, ownership string")
    over = spark.createDataFrame([], "source_object_id bigint, entity_id string, ord int")
    entities = spark.createDataFrame([("floor:1", "floor"), ("space:1", "space"), ("space:2", "space")], "entity_id string, type string")
    domains = spark.createDataFrame([], "poly_id bigint, entity_id string, kind string, min_y double, max_y double, tolerance double, shared_with string, roles array<string>, source_object_ids array<bigint>")
    line = spark.createDataFrame([], "entity_id string, line_id bigint, seq bigint, x1 double, z1 double, x2 double, z2 double, show_ground boolean")
    got = audits.pick_entities(hits, cells, rules, 8.0, 4, objects, over, entities, hits.select("pt_id", F.lit(0.0).alias("ground")), spark.createDataFrame([], EDGES), domains, line)
    assert {r.ray_id: (r.hit_id, r.entity_id, r.method) for r in got.collect()} == {
        1: (1, None, "unassigned-visible-surface"), 2: (4, "space:1", "explicit-source-owner"), 3: (7, "space:2", "explicit-source-owner"), 4: (8, None, "unassigned-visible-surface")}


def test_registry_rules_of_each_kind(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "x", None), (3, None, 7), (3, "y", 9)], "id bigint, owner string, ref bigint")
    b = spark.createDataFrame([(5, 1.0), (7, 2.0), (8, 3.0)], "ref bigint, size double")
    rules = [registry.Row("small", "b", "size < 2", "ref"), registry.Row("never", "b", "size < 0", "ref"), registry.Known("ref", "a", "ref", "b", "ref", "id"), registry.Known("unused", "b", "ref", "a", "ref"),
             registry.Unique("id", "a", "id"), registry.Unique("owners", "a", "owner", "id"), registry.Group("many", "a", "owner", "count(*) > 1"), registry.Match("pair", "a", "b", (("ref", "ref"),), "b.size > 1.5", "a.id")]
    found = registry.violations({"a": a, "b": b}, rules)
    assert sorted((r.rule, r.key) for r in found.collect()) == [("id", "3"), ("many", "x"), ("owners", "x"), ("pair", "3"), ("ref", "3"), ("small", "5"), ("unused", "8")]
    counts = {r.rule: r.violations for r in registry.summary(found, rules).collect()}
    assert counts["never"] == 0 and counts["id"] == 1 and set(registry.TREE_RULES) < set(counts)


def test_every_registry_rule_is_named_once():
    names = [r.name for r in registry.rules()]
    assert len(names) == len(set(names)) and not set(names) & set(registry.TREE_RULES)


def chain(spark, costs, budget, slots=3, scores=None):
    """Lines 0..n-1, each linked with the next, with a partition each."""
    n = len(costs)
    lines = spark.createDataFrame([(1, i, float((scores or range(100, 100 - 10 * n, -10))[i])) for i in range(n)], "pose_id bigint, line_id bigint, score double")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a bigint, b bigint")
    parts = spark.createDataFrame([(1, i, i, c) for i, c in enumerate(costs)], "pose_id bigint, line_id bigint, part_id bigint, bytes bigint")
    found = roads.corridor(lines, links)
    out = roads.grow_corridor(found, links, parts, spark.createDataFrame([(1, budget)], "pose_id bigint, budget bigint"), slots)
    return {r.line_id: (r.accepted, r.paid) for r in out.collect()}


def test_no_jump_over_a_deferred_middle(spark):
    assert chain(spark, [1, 100, 1], 3) == {0: (True, 1), 1: (False, 100), 2: (False, None)}
    assert chain(spark, [1, 1, 1], 3) == {0: (True, 1), 1: (True, 1), 2: (True, 1)}
    assert chain(spark, [1, 1, 1], 9, slots=2) == {0: (True, 1), 1: (True, 1), 2: (False, 1)}


def test_growth_goes_both_ways_and_is_tried_once(spark):
    # the primary is in the middle; its lower-ranked end is reached in the same pass, its higher-ranked one in the next
    assert chain(spark, [4, 4, 4, 4], 12, slots=9, scores=[50, 60, 90, 70]) == {2: (True, 4), 3: (True, 4), 1: (True, 4), 0: (False, 4)}
    assert chain(spark, [9, 4], 5) == {0: (False, 9), 1: (False, None)}


def test_primary_is_held_and_near_lines_stay(spark):
    lines = spark.createDataFrame([(1, 1, 100.0, 310.0), (1, 2, 90.0, 200.0), (1, 3, 10.0, 340.0)], "pose_id bigint, line_id bigint, score double, distance double")
    held = spark.createDataFrame([(1, 1), (1, 3)], "pose_id bigint, line_id bigint")
    assert sorted(r.line_id for r in roads.near_lines(lines).collect()) == [2]
    assert sorted(r.line_id for r in roads.near_lines(lines, held).collect()) == [1, 2]
    links = spark.createDataFrame([], "a bigint, b bigint")
    old = spark.createDataFrame([(1, 2)], "pose_id bigint, line_id bigint")
    lead = lambda **kw: [r.line_id for r in roads.corridor(lines, links, **kw).collect()]
    assert lead() == [1] and lead(primary=old) == [2] and lead(primary=old, hold=1.05) == [1]


def test_a_road_behind_the_camera_is_not_seen(spark):
    pose = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, -1.0)],
                                 "pose_id bigint, ex double, ey double, ez double, rx double, ry double, rz double, ux double, uy double, uz double, fx double, fy double, fz double")

    def at(z):
        dem = spark.createDataFrame([(r, c, 10.0) for r in range(12) for c in range(12)], "row_no bigint, col_no bigint, h double")
        seg = spark.createDataFrame([(7, 0, 45.0, 50.0 + z, 55.0, 50.0 + z)], "line_id bigint, seq int, x1 double, z1 double, x2 double, z2 double")
        pieces = roads.ground_steps(seg, dem, 10.0, 12, 12)
        assert pieces.count() == 2
        moved = pieces.withColumns({f"{e}{a}": F.col(f"{e}{a}") - 50 for e in "ab" for a in "xz"})
        return roads.line_view_score(roads.seen_pieces(pose, moved, 900.0, 16 / 9, 42.0)).collect()

    assert at(20.0) == []
    (ahead,) = at(-20.0)
    assert ahead.pixels == pytest.approx(10 / 20 / math.tan(math.radians(21)) * 450) and ahead.distance == pytest.approx(20.0)


def test_lines_that_look_the_same_tie_in_any_order_of_pieces(spark):
    rows = [(1, line, v, 100 * v, 5.0) for line, parts in ((7, (0.1, 0.2, 0.3)), (8, (0.3, 0.2, 0.1))) for v in parts]
    seen = spark.createDataFrame(rows, "pose_id long, line_id long, score double, pixels double, distance double").coalesce(1)
    scores = {r.line_id: (r.score, r.pixels) for r in roads.line_view_score(seen).collect()}
    assert scores == {7: (0.6, 60.0), 8: (0.6, 60.0)}
