"""Coverage reports on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from landfold.operators import coverage as cov


def square(spark, *rows):
    """Squares (poly_id, x, z, side) as polygons."""
    boxes = spark.createDataFrame([(i, x, z, x + s, z + s) for i, x, z, s in rows], "poly_id bigint, min_x double, min_z double, max_x double, max_z double")
    return cov.box_edges(boxes, "poly_id")


def test_native_coverage_names_what_is_known(spark):
    entities = spark.createDataFrame([("a", None), ("b", "bundle"), ("c", None), ("d", None)], "entity_id string, bundle_id string")
    outlines = spark.createDataFrame([(1, "a", 1, "named"), (2, "a", 0, "official"), (3, "b", 0, "official")], "poly_id bigint, entity_id string, rank int, source string")
    edges = square(spark, (1, 0.0, 0.0, 4.0), (2, 2.0, 0.0, 4.0), (3, 100.0, 0.0, 4.0))
    spots = spark.createDataFrame([("a", 0.5, 0.5), ("c", 50.5, 50.5)], "entity_id string, x double, z double")
    patches = spark.createDataFrame([(7, 0, 0), (7, 0, 1), (8, 0, 1), (8, 50, 50)], "patch_id bigint, row_no bigint, col_no bigint")
    leaves = spark.createDataFrame([(1, 8.0, 0.0, 9.0, 1.0, True, True, 2.0), (2, 8.0, 0.0, 9.0, 1.0, True, False, 4.0), (3, 1.0, 1.0, 2.0, 2.0, False, True, 9.0), (4, 30.0, 0.0, 31.0, 1.0, True, False, 0.0),
                                    (5, 50.0, 50.0, 51.0, 51.0, True, None, None)], "leaf_id bigint, min_x double, min_z double, max_x double, max_z double, available boolean, downloaded boolean, error double")
    got = {r.entity_id: r for r in cov.native_coverage(entities, outlines, edges, spots, patches, leaves, 1.0, 3.0).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    # two outlines of four by four share a strip of two by four
    assert (a.domain_source, a.samples, a.patches, a.covered, a.best_percent, a.conclusion) == ("official", 24, 2, 2, pytest.approx(8.33), "native-projection")
    assert (a.leaves, a.downloaded, a.missing, a.open, a.max_error) == (2, 1, 1, 1, 4.0)
    assert (b.conclusion, b.covered, b.best_percent, b.leaves) == ("independent-exterior", 0, None, 0)
    assert (c.domain_source, c.samples, c.covered, c.open, c.conclusion) == ("reference-point-only", 1, 1, 1, "no-verified-domain")
    assert (d.domain_source, d.samples, d.conclusion) == ("none", 0, "no-verified-domain")


def test_leaves_to_be_had(spark):
    owners = square(spark, (1, 0.0, 0.0, 20.0), (2, 100.0, 0.0, 20.0), (3, 500.0, 0.0, 5.0))
    inner = square(spark, (11, 0.0, 0.0, 2.0), (12, 15.0, 15.0, 2.0), (13, 3.0, 0.0, 2.0), (21, 100.0, 0.0, 2.0), (31, 500.0, 0.0, 2.0), (14, 1.0, 3.0, 1.0))
    leaves = inner.withColumn("owner_id", (inner.poly_id / 10).cast("bigint"))
    targets = square(spark, (1, -3.0, 0.0, 2.0), (2, 98.0, 0.0, 1.0), (3, -3.0, 1.0, 2.0))
    targets = targets.withColumn("entity_id", F.when(F.col("poly_id") == 1, "x").when(F.col("poly_id") == 3, "y"))
    index = spark.createDataFrame([(11, 10), (14, None), (21, 5), (12, 99)], "leaf_id bigint, bytes bigint")
    published = spark.createDataFrame([(2, None), (9, None), (1, 77)], "owner_id bigint, leaf_id bigint")
    taken = cov.acquisition_leaves(owners, leaves, targets, index, published, 5.0)
    assert sorted((r.owner_id, r.leaf_id, r.entity_id or "", r.state, r.bytes) for r in taken.collect()) == [
        (1, 11, "x", "new", 10), (1, 11, "y", "new", 10), (1, 13, "x", "missing", None), (1, 13, "y", "missing", None), (1, 14, "x", "new", 0), (1, 14, "y", "new", 0), (2, 21, "", "published", None)]
    by_owner = {r.owner_id: r for r in cov.acquisition_owners(taken).collect()}
    assert (by_owner[1].leaves, by_owner[1].new_leaves, by_owner[1].new_bytes, by_owner[1].entities, by_owner[1].corridor) == (3, 2, 10, 2, False)
    assert (by_owner[2].published_leaves, by_owner[2].new_bytes, by_owner[2].entities, by_owner[2].corridor) == (1, 0, 0, True)
    assert sorted((r.entity_id, r.owners, r.planned_owners, r.missing_leaves) for r in cov.acquisition_entities(taken).collect()) == [("x", 1, 1, 1), ("y", 1, 1, 1)]


def test_hull_of_points_is_a_polygon(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 2.0), (1, 0.0, 2.0), (1, 1.0, 1.0), (2, 0.0, 0.0), (2, 1.0, 1.0)], "k bigint, x double, z double")
    rows = cov.hull_edges(points, "k").collect()
    assert {r.poly_id for r in rows} == {1} and len(rows) == 4 and sum(r.x1 * r.z2 - r.x2 * r.z1 for r in rows) == 8


def test_coverage_of_picks(spark):
    registry = spark.createDataFrame([("a", "building", "open", None), ("b", "building", "construction", None), ("c", "building", "open", "a"), ("d", "building", "open", None), ("z", "zone", "open", None), ("e", "building", "open", None)],
                                     "entity_id string, type string, status string, shared_with string")
    objects = spark.createDataFrame([(1, "exterior", "p", "a"), (2, "exterior", "p", "a"), (3, "current-form", "q", "d"), (4, "exterior", "r", "e")], "object_id bigint, layer string, bundle_id string, entity_id string")
    findings = spark.createDataFrame([("exterior", "a", "roof", "a", "pass"), ("exterior", "a", "facade", "z", "misassigned"), ("current-form", "d", "facade", "d", "pass-static-owner"), ("exterior", "e", "roof", None, "missed-owner")],
                                     "layer string, entity_id string, kind string, picked_id string, status string")
    domains = spark.createDataFrame([("a",), ("a",), ("w",)], "entity_id string")
    got = {r.entity_id: (r.coverage, r.scope_role, r.findings, r.bundles, r.current_forms, r.domains, set(r.flags)) for r in cov.pick_coverage(registry, objects, findings, domains).collect()}
    assert got["a"] == ("partial-one-surface-ray", "direct-visible-scope", 2, 1, 0, 2, {"no-current-form", "multiple-domains-or-shared-scope"})
    assert got["b"][:2] == ("list-or-registry-only", "construction-or-upcoming-record") and got["c"][1] == "named-member-of-shared-physical-domain"
    assert got["d"][0] == "partial-one-surface-ray" and got["d"][6] == {"no-exterior-bundle"}
    assert got["e"][0] == "no-independent-hit" and "missing-visible-geometry-or-owner" in got["e"][6]
    assert got["z"][:3] == ("list-or-registry-only", "current-service-name-without-independent-domain", 1) and got["w"][5] == 1 and len(got) == 7


def test_triage_of_what_owners_hold(spark):
    buildings = spark.createDataFrame([("a", 2.0, True), ("b", None, None)], "entity_id string, area double, focus boolean")
    owners = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3)], "entity_id string, owner_id bigint")
    levels = spark.createDataFrame([(1, "high", 100, 10), (1, "fine", 150, 10), (2, "high", 100, 10)], "owner_id bigint, level string, triangles bigint, texture_bytes bigint")
    masks = spark.createDataFrame([(1, "high", 0, 0), (2, "high", 0, 0), (1, "fine", 0, 0), (1, "fine", 0, 1)], "owner_id bigint, level string, row_no bigint, col_no bigint")
    none = spark.createDataFrame([], "entity_id string, triangles bigint")
    forms = spark.createDataFrame([("a", "building", None, "PENDING"), ("b", "building", "installed-set", None)], "entity_id string, kind string, status string, adoption string")
    got = {r.entity_id: r for r in cov.quality_triage(buildings, owners, levels, masks, none, forms, 0.5).collect()}
    a, b = got["a"], got["b"]
    assert (a.owners, a.missing_owners, a.triangle_ratio, a.texture_ratio, a.high_area, a.fine_area, a.inflation, a.area_gain) == (3, 1, 0.75, 0.5, 0.25, 0.5, 0.25, 100.0)
    assert (a.level, a.score, a.needs_review) == ("P0", 5 + 2 + 3 + 2 + 2 + 1, True)
    assert (b.triangle_ratio, b.inflation, b.needs_review, b.score, b.level, b.reasons) == (None, None, False, 5, "P1", ["current-form"])


def test_floors_as_converted(spark):
    floors = spark.createDataFrame([(1, True), (2, False), (3, True)], "floor_id bigint, shown boolean")
    features = spark.createDataFrame([(1, 10, False, "A"), (1, 11, None, "B"), (1, 12, False, " "), (1, 13, False, "no part"), (2, 20, False, "C")], "floor_id bigint, feature_id bigint, hidden boolean, name string")
    ring = lambda f, part, y, shift=0.0, bump=0.0: [(f, part, 0, s, x + (shift if s == 3 else 0.0), y + (bump if s == 1 else 0.0), z) for s, (x, z) in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)))]
    rows = ring(10, 0, 1.0) + ring(10, 1, 2.0) + ring(11, 0, 1.0, shift=0.5) + ring(12, 0, 2.0, bump=1.0) + ring(20, 0, 1.0)
    vertices = spark.createDataFrame(rows, "feature_id bigint, part int, ring int, seq int, x double, y double, z double")
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, 0.0), (1, 2.0, 2.0, 2.0, 2.0004), (2, 0.0, 0.0, 1.0, 0.0)], "floor_id bigint, x1 double, z1 double, x2 double, z2 double")
    stats = cov.floor_statistics(floors, features, vertices, lines)
    got = {r.floor_id: r for r in stats.collect()}
    one, three = got[1], got[3]
    assert set(got) == {1, 3} and (one.features, one.labelled, one.named, one.background, one.unsupported, one.parts, one.segments) == (4, 2, 1, 1, 1, 4, 1)
    assert (one.heights, one.z, one.modal_z, one.open_rings, one.uneven_parts, one.min_x, one.max_x) == (2, None, 1.0, 1, 1, 0.0, 1.0)
    assert (three.features, three.heights, three.z) == (0, 0, None)
    total = cov.floor_totals(stats).first()
    assert (total.floors, total.parts, total.without_labelled, total.with_lines, total.with_several_heights) == (2, 4, 1, 1, 1)
