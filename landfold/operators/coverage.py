"""Coverage of buildings: what exists of each, what a pick finds on it, what is still to be had, and what to look at first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.functions.codecs import pct, ratio
from landfold.functions.geometry import face_normal, normalise
from landfold.operators import audits, mesh, polygons, raster
from landfold.operators.frames import HULL_PARTS, convex_hull
from landfold.operators.scoring import triage
from landfold.plans.gridjoin import points_in_boxes
from landfold.session import cut_lineage

#: shares of an upward normal from which, and up to which, a face is taken for roof or facade (fixed values)
ROOF, FACADE = 0.72, 0.28


def box_edges(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes (key, min_x, min_z, max_x, max_z) as polygons of four edges."""
    corners = [("min_x", "min_z"), ("max_x", "min_z"), ("max_x", "max_z"), ("min_x", "max_z")]
    sides = [F.struct(F.lit(i).alias("seq"), *[F.col(c).alias(f"{a}{n}") for n, p in ((1, corners[i]), (2, corners[(i + 1) % 4])) for a, c in zip("xz", p)]) for i in range(4)]
    return boxes.select(F.col(key).alias("poly_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.inline(F.array(*sides)))


def hull_edges(points: DataFrame, key: str, parts: int = HULL_PARTS) -> DataFrame:
    """The hulls of each key's points (key, x, z) as polygons, written once; keys whose points lie on a line have none.

    parts: as for convex_hull(); one is enough for the corners of a single volume.
    """
    hull = cut_lineage(convex_hull(points, key, parts))
    n = hull.groupBy(key).agg(F.count("*").alias("n")).where("n > 2")
    a = hull.join(n, key).select(key, "seq", F.col("x").alias("x1"), F.col("z").alias("z1"), ((F.col("seq") + 1) % F.col("n")).alias("next"))
    b = hull.select(key, F.col("seq").alias("next"), F.col("x").alias("x2"), F.col("z").alias("z2"))
    return cut_lineage(a.join(b, [key, "next"]).select(F.col(key).alias("poly_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", "x1", "z1", "x2", "z2"))


def native_coverage(entities: DataFrame, outlines: DataFrame, edges: DataFrame, spots: DataFrame, projections: DataFrame, leaves: DataFrame, step: float, guard: float = 10.0) -> DataFrame:
    """One row per entity: the cells of its domain that published patches cover, and the source leaves around it.

    entities: entity_id, bundle_id (its independent exterior, NULL for none); outlines: poly_id, entity_id, rank, source (of
    an entity's sources the least rank names the domain, all outlines belong to it); spots: entity_id, x, z, the reference
    position, used where there is no outline; projections: patch_id, row_no, col_no of the cells, of this step, that a patch
    covers; leaves: leaf_id, min_x..max_z, available, downloaded, error.
    Columns: domain_source, samples, patches, covered (by any patch), best_percent (of one patch), leaves, downloaded,
    missing, open (available and not downloaded), max_error (of available leaves), conclusion. A leaf counts when its box
    comes within the guard of the domain or holds the reference position. Cells fold by entity before they meet patches.
    """
    named = outlines.groupBy("entity_id").agg(F.min(F.struct("rank", "source"))["source"].alias("source"))
    lone = spots.join(named.select("entity_id"), "entity_id", "left_anti")
    at = lambda c: F.floor(F.col(c) / step).cast("bigint")
    area = raster.cells_in_polygons(edges, step).join(outlines.select("poly_id", "entity_id"), "poly_id").select("entity_id", "row_no", "col_no").distinct()
    cells = cut_lineage(area.unionByName(lone.select("entity_id", at("z").alias("row_no"), at("x").alias("col_no"))))
    size = cells.groupBy("entity_id").agg(F.count("*").alias("samples"))
    met = cut_lineage(cells.join(projections.select("patch_id", "row_no", "col_no").distinct(), ["row_no", "col_no"]))
    covered = met.select("entity_id", "row_no", "col_no").distinct().groupBy("entity_id").agg(F.count("*").alias("covered"))
    best = met.groupBy("entity_id", "patch_id").agg(F.count("*").alias("n")).groupBy("entity_id").agg(F.count("*").alias("patches"), F.max("n").alias("best"))

    near = polygons.within_distance(edges, box_edges(leaves, "leaf_id"), guard).select(F.col("a_id").alias("poly_id"), F.col("b_id").alias("leaf_id"))
    near = near.join(outlines.select("poly_id", "entity_id"), "poly_id").select("entity_id", "leaf_id")
    boxes = leaves.select("leaf_id", F.col("min_x").alias("bx0"), F.col("min_z").alias("bz0"), F.col("max_x").alias("bx1"), F.col("max_z").alias("bz1"))
    held = points_in_boxes(lone.select("entity_id", "x", "z"), boxes).select("entity_id", "leaf_id")
    around = near.unionByName(held).distinct().join(leaves.select("leaf_id", "available", "downloaded", "error"), "leaf_id")
    have = F.coalesce("available", F.lit(False))
    here = have & F.coalesce("downloaded", F.lit(False))
    around = around.groupBy("entity_id").agg(
        F.count(F.when(have, 1)).alias("leaves"), F.count(F.when(here, 1)).alias("downloaded"), F.count(F.when(~have, 1)).alias("missing"),
        F.count(F.when(have & ~here, 1)).alias("open"), F.max(F.when(have, F.col("error"))).alias("max_error"))

    kinds = named.unionByName(lone.select("entity_id", F.lit("reference-point-only").alias("source")).distinct())
    j = reduce(lambda a, b: a.join(b, "entity_id", "left"), [entities.select("entity_id", "bundle_id"), kinds, size, covered, best, around])
    zero = F.lit(0).cast("bigint")
    domain = F.coalesce("source", F.lit("none"))
    conclusion = (F.when(domain.isin("none", "reference-point-only"), "no-verified-domain").when(F.col("bundle_id").isNotNull(), "independent-exterior")
                  .when(F.col("patches") > 0, "native-projection").otherwise("baseline-only"))
    return j.select("entity_id", domain.alias("domain_source"), *[F.coalesce(c, zero).alias(c) for c in ("samples", "patches", "covered")], pct("best", "samples").alias("best_percent"),
                    *[F.coalesce(c, zero).alias(c) for c in ("leaves", "downloaded", "missing", "open")], "max_error", conclusion.alias("conclusion"))


def acquisition_leaves(owners: DataFrame, leaves: DataFrame, targets: DataFrame, index: DataFrame, published: DataFrame, guard: float = 10.0) -> DataFrame:
    """(owner_id, leaf_id, entity_id, state, bytes) of the leaves to be had for each target, once per leaf and target entity.

    owners and leaves: edges of the hulls of their projected volumes, poly_id being owner_id, and leaf_id with a column
    owner_id; targets: edges with a column entity_id, NULL for a corridor; index: leaf_id, bytes (NULL: 0), what the source
    offers; published: owner_id, leaf_id, where a NULL leaf_id stands for the whole owner. An owner that comes within the
    guard of a target is opened, and of its leaves those that do so too are taken. state: published, missing or new.
    """
    names = targets.select(F.col("poly_id").alias("b_id"), "entity_id").distinct()
    of = leaves.select(F.col("poly_id").alias("a_id"), "owner_id").distinct()
    opened = polygons.within_distance(owners, targets, guard).select(F.col("a_id").alias("owner_id"), "b_id")
    taken = polygons.within_distance(leaves, targets, guard).join(of, "a_id").join(opened, ["owner_id", "b_id"], "left_semi")
    taken = taken.join(names, "b_id").select("owner_id", F.col("a_id").alias("leaf_id"), "entity_id").distinct()
    whole = published.where("leaf_id is null").select("owner_id").distinct().withColumn("owner_out", F.lit(True))
    single = published.where("leaf_id is not null").select("leaf_id").distinct().withColumn("leaf_out", F.lit(True))
    offer = index.select("leaf_id", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    j = cut_lineage(taken).join(whole, "owner_id", "left").join(single, "leaf_id", "left").join(offer, "leaf_id", "left")
    state = F.when(F.coalesce("owner_out", "leaf_out").isNotNull(), "published").when(F.col("bytes").isNull(), "missing").otherwise("new")
    return j.select("owner_id", "leaf_id", "entity_id", state.alias("state"), F.when(state == "new", F.col("bytes")).alias("bytes"))


def _by_state(leaves: DataFrame, key: str) -> DataFrame:
    """Leaves by state and the bytes of new ones; each leaf of a key counts once."""
    once = leaves.groupBy(key, "leaf_id").agg(F.max("state").alias("state"), F.max("bytes").alias("bytes"))
    counts = [F.count(F.when(F.col("state") == s, 1)).alias(f"{s}_leaves") for s in ("published", "missing", "new")]
    return once.groupBy(key).agg(F.count("*").alias("leaves"), *counts, F.coalesce(F.sum("bytes"), F.lit(0)).alias("new_bytes"))


def acquisition_owners(taken: DataFrame) -> DataFrame:
    """(owner_id, leaves, published_leaves, missing_leaves, new_leaves, new_bytes, entities, corridor) of acquisition_leaves()."""
    pairs = taken.groupBy("owner_id", "entity_id").agg(F.lit(1).alias("one"))
    reach = pairs.groupBy("owner_id").agg(F.count("entity_id").alias("entities"), F.max(F.col("entity_id").isNull()).alias("corridor"))
    return _by_state(taken, "owner_id").join(reach, "owner_id")


def acquisition_entities(taken: DataFrame) -> DataFrame:
    """(entity_id, leaves .. new_bytes, owners, planned_owners): per entity; planned owners are those with a new leaf for it."""
    named = taken.where("entity_id is not null")
    owners = named.groupBy("entity_id", "owner_id").agg(F.max(F.col("state") == "new").alias("plan"))
    owners = owners.groupBy("entity_id").agg(F.count("*").alias("owners"), F.count(F.when(F.col("plan"), 1)).alias("planned_owners"))
    return _by_state(named, "entity_id").join(owners, "entity_id")


def pick_findings(surfaces: DataFrame, objects: DataFrame, ground: Column, edges: DataFrame, domains: DataFrame, roads: DataFrame, most_tolerance: float = 0.0) -> DataFrame:
    """(object_id, layer, kind, tri_idx, expected_id, picked_id, method, status): each object picked at its largest roof and facade.

    surfaces: object_id, tri_idx, x1..z3; objects: object_id, layer (exterior or current-form), entity_id (of its bundle or
    its set), owner_id (recorded on the surface, NULL for none), range_owner_id (one that only a range can find), role;
    ground: the height below a point. A pick goes through the middle of the face by attribute_cascade(). An object
    without a face of a kind has no row of it.
    """
    steep = surfaces.withColumn("ny", F.abs(normalise(face_normal())[1]))
    sides = cut_lineage(steep.withColumn("kind", F.when(F.col("ny") >= ROOF, "roof").when(F.col("ny") <= FACADE, "facade")).where("kind is not null"))
    seen = mesh.witnesses(sides, ["object_id", "kind"]).select("object_id", "kind", "tri_idx").join(sides, ["object_id", "kind", "tri_idx"])
    middle = {a: (F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 3 for a in "xyz"}
    own = F.when(F.col("layer") == "current-form", F.col("entity_id")).otherwise(F.col("owner_id"))
    at = seen.select("object_id", "kind", "tri_idx", "ny", *[v.alias(a) for a, v in middle.items()]).join(objects.withColumn("owner", own), "object_id")
    at = cut_lineage(at.withColumn("pt_id", F.struct("object_id", "kind")))
    points = at.select("pt_id", "x", "y", "z", "ny", F.col("owner").alias("explicit_id"), "role", F.col("object_id").alias("source_object_id"), F.lit(False).alias("preserved"))
    told = audits.attribute_cascade(points, at.select("pt_id", ground.alias("ground")), edges, domains, roads, most_tolerance)
    j = at.join(told.withColumnRenamed("entity_id", "picked_id"), "pt_id").withColumn("expected_id", F.coalesce("owner", "range_owner_id"))
    right, some = F.col("picked_id") == F.col("expected_id"), F.col("picked_id").isNotNull()
    exterior = (F.when(F.col("expected_id").isNotNull(), F.when(right, "pass").when(some, "misassigned").otherwise("missed-owner"))
                .when(some, F.when(F.col("role") == "source-photogrammetry-gap-surface", "unowned-supplement-fallback").otherwise("misassigned")).otherwise("unassigned-visible-surface"))
    status = F.when(F.col("layer") == "current-form", F.when(right, "pass-static-owner").otherwise("fail")).otherwise(exterior)
    return j.select("object_id", "layer", "entity_id", "kind", "tri_idx", "expected_id", "picked_id", "method", status.alias("status"))


def pick_coverage(registry: DataFrame, objects: DataFrame, findings: DataFrame, domains: DataFrame) -> DataFrame:
    """(entity_id, coverage, scope_role, findings, bundles, current_forms, domains, flags) of every building and whatever else a pick or an object names.

    registry: entity_id, type, status, shared_with (the entity whose exterior it shares); objects: as for pick_findings(),
    with bundle_id; findings: its rows, each counted for the entity of its object and for the one picked; domains: entity_id.
    """
    ours = findings.select("entity_id", "kind", "status")
    others = findings.where("layer = 'exterior' and picked_id is not null and not (picked_id <=> entity_id)").select(F.col("picked_id").alias("entity_id"), "kind", "status")
    good = F.col("status").isin("pass", "pass-static-owner")
    seen = ours.unionByName(others).groupBy("entity_id").agg(
        F.count("*").alias("findings"), F.max((F.col("kind") == "roof") & good).alias("roof"), F.max((F.col("kind") == "facade") & good).alias("facade"))
    held = objects.groupBy("entity_id", "layer", "bundle_id").agg(F.lit(1).alias("one")).groupBy("entity_id").agg(
        F.count(F.when(F.col("layer") == "exterior", 1)).alias("bundles"), F.count(F.when(F.col("layer") == "current-form", 1)).alias("current_forms"))
    areas = domains.groupBy("entity_id").agg(F.count("*").alias("domains"))
    ids = [registry.where("type = 'building'").select("entity_id"), *[d.select("entity_id") for d in (seen, held, areas)]]
    j = reduce(DataFrame.unionByName, ids).where("entity_id is not null").distinct()
    for other in (seen, held, areas, registry.select("entity_id", F.col("status").alias("life"), "shared_with")):
        j = j.join(other, "entity_id", "left")
    no = F.lit(False)
    j = j.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("findings", "bundles", "current_forms", "domains")} | {c: F.coalesce(c, no) for c in ("roof", "facade")})
    coverage = (F.when(F.col("roof") & F.col("facade"), "direct-roof-and-facade-ray-proven").when(F.col("roof") | F.col("facade"), "partial-one-surface-ray")
                .when(F.col("current_forms") > 0, "current-form-manifest-only").when(F.col("bundles") > 0, "no-independent-hit").otherwise("list-or-registry-only"))
    j = j.withColumn("coverage", coverage)
    role = (F.when(F.col("coverage") != "list-or-registry-only", "direct-visible-scope").when(F.col("life") == "construction", "construction-or-upcoming-record")
            .when(F.col("shared_with").isNotNull(), "named-member-of-shared-physical-domain").otherwise("current-service-name-without-independent-domain"))
    flags = F.array_compact(F.array(
        F.when(F.col("bundles") == 0, "no-exterior-bundle"), F.when(F.col("current_forms") == 0, "no-current-form"),
        F.when(F.col("domains") > 1, "multiple-domains-or-shared-scope"), F.when(F.col("coverage") == "no-independent-hit", "missing-visible-geometry-or-owner")))
    return j.select("entity_id", "coverage", role.alias("scope_role"), "findings", "bundles", "current_forms", "domains", flags.alias("flags"))


def quality_triage(buildings: DataFrame, owners: DataFrame, levels: DataFrame, masks: DataFrame, exteriors: DataFrame, forms: DataFrame, pixel: float) -> DataFrame:
    """One row per building: what its owners hold at both levels, what the finer one gains, and how soon to look at it.

    buildings: entity_id, area (NULL if unknown), focus; owners: entity_id, owner_id; levels: owner_id, level (high or fine),
    triangles, texture_bytes; masks: owner_id, level, row_no, col_no of pixels; exteriors: entity_id, triangles; forms:
    entity_id, kind, status, adoption. An owner without levels is missing. The mask areas are of the union over owners.
    A current form needs a review when it is a space, is not installed, or its adoption is pending.
    """
    links = owners.select("entity_id", "owner_id").distinct()
    known = levels.select("owner_id").distinct().withColumn("mapped", F.lit(True))
    count = links.join(known, "owner_id", "left").groupBy("entity_id").agg(F.count("*").alias("owners"), F.count(F.when(F.col("mapped").isNull(), 1)).alias("missing_owners"))
    of = lambda level, c: F.coalesce(F.sum(F.when(F.col("level") == level, F.col(c))), F.lit(0)).alias(f"{level}_{c}")
    sums = levels.groupBy("owner_id", "level").agg(F.sum("triangles").alias("triangles"), F.sum("texture_bytes").alias("texture_bytes"))
    sums = links.join(sums, "owner_id").groupBy("entity_id").agg(*[of(level, c) for level in ("high", "fine") for c in ("triangles", "texture_bytes")])
    cells = links.join(masks.select("owner_id", "level", "row_no", "col_no"), "owner_id").select(F.struct("entity_id", "level").alias("at"), "row_no", "col_no", F.lit(pixel).alias("pixel"))
    areas = raster.union_area(cells, "at", "pixel").groupBy("at.entity_id").agg(*[F.max(F.when(F.col("at.level") == v, F.col("area"))).alias(f"{v}_area") for v in ("high", "fine")])
    outside = exteriors.groupBy("entity_id").agg(F.count("*").alias("exteriors"), F.sum("triangles").alias("exterior_triangles"))
    review = (F.col("kind") == "current-form-space") | (F.col("status").isNotNull() & (F.col("status") != "installed-set")) | F.lower(F.coalesce("adoption", F.lit(""))).contains("pending")
    current = forms.groupBy("entity_id").agg(F.count("*").alias("forms"), F.max(F.coalesce(review, F.lit(False))).alias("review"))
    j = buildings.select("entity_id", "area", "focus")
    for other in (count, sums, areas, outside, current):
        j = j.join(other, "entity_id", "left")
    zero = F.lit(0).cast("bigint")
    counts = ("owners", "missing_owners", "high_triangles", "fine_triangles", "high_texture_bytes", "fine_texture_bytes", "exteriors", "exterior_triangles", "forms")
    j = j.withColumns({c: F.coalesce(c, zero) for c in counts} | {c: F.coalesce(c, F.lit(0.0)) for c in ("high_area", "fine_area")} | {"focus": F.coalesce("focus", F.lit(False))})
    j = j.withColumns({
        "triangle_ratio": ratio("fine_triangles", "high_triangles"), "texture_ratio": ratio("fine_texture_bytes", "high_texture_bytes"),
        "inflation": ratio("fine_area", "area"), "area_gain": pct(F.col("fine_area") - F.col("high_area"), "high_area"),
        "current_form": F.col("forms") > 0, "needs_review": F.coalesce("review", F.lit(False))})
    return triage(j).select("entity_id", *counts, "high_area", "fine_area", "triangle_ratio", "texture_ratio", "inflation", "area_gain", "needs_review", "score", "level", "reasons")


def floor_statistics(floors: DataFrame, features: DataFrame, vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per floor that is shown: its features, their parts and heights, its drawn lines, and what is wrong with it.

    floors: floor_id, shown; features: floor_id, feature_id, hidden (NULL: hidden), name; vertices: feature_id, part, ring,
    seq, x, y (the height), z; lines: floor_id, x1, z1, x2, z2. A feature without a part is unsupported, a hidden one is
    background, the others are labelled. heights: distinct heights of parts, to 6 digits; z: the height if there is one;
    modal_z: the commonest, the lowest of equals; segments: lines of a millimetre or more, once whatever their direction.
    open_rings and uneven_parts count rings whose ends differ and parts of more than one height.
    """
    shown = floors.where("shown").select("floor_id")
    f = features.join(shown, "floor_id").select("floor_id", "feature_id", F.coalesce("hidden", F.lit(True)).alias("hidden"), "name")
    level = F.round("y", 6)
    rings = vertices.groupBy("feature_id", "part", "ring").agg(
        F.min(level).alias("lo"), F.max(level).alias("hi"), F.min_by(F.struct("x", "z"), "seq").alias("head"), F.max_by(F.struct("x", "z"), "seq").alias("tail"),
        *[fn(c).alias(f"{n}_{c}") for c in "xz" for n, fn in (("min", F.min), ("max", F.max))])
    bounds = [fn(f"{n}_{c}").alias(f"{n}_{c}") for c in "xz" for n, fn in (("min", F.min), ("max", F.max))]
    parts = rings.groupBy("feature_id", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.when(F.col("head") != F.col("tail"), 1)).alias("open"), *bounds)
    parts = cut_lineage(f.join(parts, "feature_id"))
    whole = parts.groupBy("floor_id", "feature_id").agg(F.lit(1).alias("supported"))
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    drawn, label = F.col("supported").isNotNull(), ~F.col("hidden")
    stats = f.join(whole, ["floor_id", "feature_id"], "left").groupBy("floor_id").agg(
        F.count("*").alias("features"), count(drawn & label, "labelled"), count(drawn & label & (F.trim(F.coalesce("name", F.lit(""))) != ""), "named"),
        count(drawn & ~label, "background"), count(~drawn, "unsupported"))
    boxes = parts.groupBy("floor_id").agg(F.count("*").alias("parts"), F.sum("open").alias("open_rings"), count(F.col("lo") != F.col("hi"), "uneven_parts"), *bounds)
    heights = parts.groupBy("floor_id", "lo").agg(F.count("*").alias("n")).groupBy("floor_id").agg(
        F.count("*").alias("heights"), F.min("lo").alias("least"), F.min(F.struct(-F.col("n"), "lo"))["lo"].alias("modal_z"))
    heights = heights.select("floor_id", "heights", F.when(F.col("heights") == 1, F.col("least")).alias("z"), "modal_z")
    ends = [F.struct(*[F.round(f"{c}{i}", 3).alias(c) for c in "xz"]) for i in (1, 2)]
    cad = lines.join(shown, "floor_id").select("floor_id", F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a <> b").distinct().groupBy("floor_id").agg(F.count("*").alias("segments"))
    j = reduce(lambda a, b: a.join(b, "floor_id", "left"), [shown, stats, boxes, heights, cad])
    counts = ("features", "labelled", "named", "background", "unsupported", "parts", "heights", "segments", "open_rings", "uneven_parts")
    return j.select("floor_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts], "z", "modal_z", *[f"{n}_{c}" for c in "xz" for n in ("min", "max")])


def floor_totals(stats: DataFrame) -> DataFrame:
    """The one row of sums over floor_statistics()."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("features", "labelled", "named", "background", "unsupported", "parts", "segments")]
    return stats.agg(F.count("*").alias("floors"), *sums, F.count(F.when(F.col("labelled") == 0, 1)).alias("without_labelled"),
                     F.count(F.when(F.col("segments") > 0, 1)).alias("with_lines"), F.count(F.when(F.col("heights") > 1, 1)).alias("with_several_heights"))
