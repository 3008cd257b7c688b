"""Composite reports built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import face_area, face_normal, normalise
from landfold.functions.text import normalize_search, search_names
from landfold.operators import attribution, linkage, mesh, polygons, raster
from landfold.plans.gridjoin import box_pairs


#: kinds of domain in the order in which they are asked
KINDS = ("association", "surface", "footprint", "range")


def attribute_cascade(points: DataFrame, ground: DataFrame, edges: DataFrame, domains: DataFrame, roads: DataFrame, most_tolerance: float = 0.0) -> DataFrame:
    """Owner and method of each visible hit, in fixed precedence; an ambiguity ends the search.

    explicit owner, association of the surface's role, outdoor surface near the ground (smallest first), single or
    ambiguous footprint, single or ambiguous range, road near the ground, unassigned. points: pt_id, x, y, z, ny,
    explicit_id, role, source_object_id, preserved (on ground that a mask keeps); ground: pt_id, ground; domains: poly_id,
    entity_id, kind, min_y, max_y, tolerance, shared_with, roles, source_object_ids; edges are those of all kinds.

    Points meet the boxes of all kinds once, where kind, height, role and object are tested; what is inside folds with
    the roads and the points themselves by pt_id.
    """
    p = points.join(ground, "pt_id", "left")
    gap = F.abs(F.col("y") - F.col("ground"))
    flat = F.coalesce(F.col("ny") >= 0.6, F.lit(False))
    like = flat & (F.coalesce(gap <= 1.25, F.lit(False)) | F.coalesce("preserved", F.lit(False)))
    p = p.withColumns({"like": like, "near": like | F.coalesce(flat & (gap <= 2), F.lit(False))})
    open_ = p.where("explicit_id is null").select("pt_id", "x", "y", "z", "like", "near", "role", "source_object_id")
    y, kind = F.col("y"), F.col("kind")
    listed = F.when(F.col("source_object_id").isNull(), F.col("role").isin("baseline", "photogrammetry")).otherwise(F.array_contains("source_object_ids", F.col("source_object_id")))
    keep = (
        ((kind == "association") & F.array_contains("roles", F.col("role")) & y.between(F.col("min_y"), F.col("max_y")))
        | ((kind == "surface") & F.col("near")) | ((kind == "footprint") & ~F.col("like") & (y >= F.col("min_y") - 0.5))
        | ((kind == "range") & ~F.col("like") & y.between(F.col("min_y") - 0.5, F.col("max_y") + 0.5) & listed)
    )
    hits = polygons.domain_hits(open_, edges, attribution.settled_envelopes(domains), keep, most_tolerance).join(polygons.poly_area(edges).select("poly_id", "net_area"), "poly_id")
    rank = F.when(kind == "surface", F.struct("net_area", "poly_id")).otherwise(F.struct(F.lit(0.0).alias("net_area"), "poly_id"))
    hits = hits.withColumns({"rank": rank, "shared_with": F.when(kind == "footprint", F.col("shared_with"))})
    found = attribution.without_shared(hits, ["pt_id", "kind"], ["rank"])
    road = attribution.nearest_line(open_.where("near"), roads).select("pt_id", F.lit("road").alias("kind"), "entity_id")
    own = p.select("pt_id", F.lit("point").alias("kind"), F.col("explicit_id").alias("entity_id"), "like")
    rows = found.unionByName(road, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)

    def of(k, value):
        return F.when(F.col("kind") == k, F.col(value))

    best = [F.min_by(of(k, "entity_id"), of(k, "rank")).alias(k) for k in ("association", "surface")]
    ends = [f(of(k, "entity_id")).alias(f"{k}_{n}") for k in ("footprint", "range") for n, f in (("lo", F.min), ("hi", F.max))]
    j = rows.groupBy("pt_id").agg(F.max(of("point", "entity_id")).alias("explicit"), F.max("like").alias("like"), F.max(of("road", "entity_id")).alias("road"), *best, *ends)
    single = {k: F.when(F.col(f"{k}_lo") == F.col(f"{k}_hi"), F.col(f"{k}_lo")) for k in ("footprint", "range")}
    rules: list[tuple[Column, Column, Column]] = [
        (F.col("explicit").isNotNull(), F.col("explicit"), F.lit("explicit-source-owner")),
        (F.col("association").isNotNull(), F.col("association"), F.lit("local-source-representation-association")),
        (F.col("surface").isNotNull(), F.col("surface"), F.lit("source-outdoor-domain-near-ground")),
        *[(F.col(f"{k}_lo").isNotNull(), single[k], F.when(single[k].isNotNull(), f"source-{k}-footprint-and-height" if k == "range" else "source-footprint-and-height").otherwise(f"ambiguous-source-{k}s"))
          for k in ("footprint", "range")],
        (F.col("road").isNotNull(), F.col("road"), F.lit("source-road-near-ground")),
        (F.col("like"), F.lit(None), F.lit("unassigned-ground")),
    ]
    owner, method = None, None
    for test, who, how in rules:
        owner = F.when(test, who) if owner is None else owner.when(test, who)
        method = F.when(test, how) if method is None else method.when(test, how)
    return j.select("pt_id", owner.alias("entity_id"), method.otherwise("unassigned-visible-surface").alias("method"))


def pick_entities(hits: DataFrame, cells: DataFrame, mask_rules: DataFrame, size: float, ground_mask: int, objects: DataFrame, overrides: DataFrame, entities: DataFrame,
                  ground: DataFrame, edges: DataFrame, domains: DataFrame, roads: DataFrame, most_tolerance: float = 0.0, near: float = 0.02) -> DataFrame:
    """(ray_id, hit_id, entity_id, method) of each ray that meets a visible surface.

    hits: pt_id, ray_id, dist, x, y, z, ny, role, source_object_id, bound_id (an owner recorded on the surface). A hit
    that a mask of its role discards is looked through; the first one left decides, so an unassigned surface hides what
    is behind it. Owners recorded on hits up to `near` behind the first come before all else, rooms before floors before
    the rest; a surface's source object has its override or its bundle as owner. All else is attribute_cascade() at the
    first hit.
    """
    seen = raster.visible_points(hits, cells, mask_rules, size, ground_mask)
    owner = linkage.object_owner(objects, overrides)
    seen = seen.join(owner, "source_object_id", "left").withColumn("owner", F.coalesce("bound_id", "owner"))
    seen = seen.join(entities.select(F.col("entity_id").alias("owner"), "type"), "owner", "left").withColumn("owner", F.when(F.col("type").isNotNull(), F.col("owner")))
    first = seen.groupBy("ray_id").agg(F.min(F.struct("dist", "pt_id")).alias("first"))
    close = seen.where("owner is not null").join(first, "ray_id").where(F.col("dist") <= F.col("first.dist") + near)
    order = F.when(F.col("type").isin("space", "facility", "connector"), 0).when(F.col("type") == "floor", 1).otherwise(2)
    bound = close.groupBy("ray_id").agg(F.min(F.struct(order.alias("order"), "dist", "pt_id", "owner")).alias("bound"))
    kept = raster.mask_samples(seen, cells, size).where((F.col("mask_id") == ground_mask) & raster.preserved_ground()).select("pt_id").distinct().withColumn("preserved", F.lit(True))
    at = first.select("ray_id", F.col("first.pt_id").alias("pt_id")).join(seen.drop("ray_id", "owner", "type"), "pt_id").join(bound, "ray_id", "left").join(kept, "pt_id", "left")
    points = at.select("pt_id", "x", "y", "z", "ny", "role", "source_object_id", "preserved", F.col("bound.owner").alias("explicit_id"))
    told = attribute_cascade(points, ground, edges, domains, roads, most_tolerance)
    return told.join(at.select("pt_id", "ray_id", F.coalesce("bound.pt_id", "pt_id").alias("hit_id")), "pt_id").select("ray_id", "hit_id", "entity_id", "method")


def search_entities(entities: DataFrame, text: str, category: Column | None = None) -> DataFrame:
    """Entities whose names in any script hold the text, exact names first, then source order. entities: entity_id, ord, name, aliases."""
    t = F.lit(text)
    wanted = normalize_search(t)
    names = F.transform(search_names("name", "aliases"), normalize_search)
    e = entities.withColumns({"names": names, "wanted": wanted})
    held = F.array_join("names", " ").contains(F.col("wanted")) if category is None else category
    hit = e.where(held & (F.col("wanted") != "")).withColumn("exact", F.array_contains("names", F.col("wanted")))
    return hit.orderBy(F.col("exact").desc(), "ord").select("entity_id", "exact")


def floater_audit(tri: DataFrame, ground: DataFrame, protected: DataFrame, top: int = 20, step: float = 1e-5) -> DataFrame:
    """Small elevated components of a tile that share no vertex with another tile and touch no protected box.

    protected: min_x..max_z. The cheap gate comes first; only its survivors are looked up elsewhere.
    """
    comp = mesh.components(tri, step, ["tile_id"])
    gate = mesh.floater_gate(mesh.component_stats(tri, comp, ground))
    tiles = comp.join(tri.select("tri_idx", "tile_id"), "tri_idx").groupBy("component").agg(F.max("tile_id").alias("tile_id"))
    lone = mesh.isolated(gate.join(tiles, "component"), comp, tri, step)
    a = lone.withColumns({f"a{x}{i}": F.col(f"{m}_{x}") for i, m in enumerate(("min", "max")) for x in "xz"})
    b = protected.select(F.col("min_y").alias("p_lo"), F.col("max_y").alias("p_hi"), *[F.col(f"{m}_{x}").alias(f"b{x}{i}") for i, m in enumerate(("min", "max")) for x in "xz"])
    shielded = box_pairs(a.select("component", "min_y", "max_y", "ax0", "az0", "ax1", "az1"), b).where("min_y <= p_hi and p_lo <= max_y").select("component")
    return lone.join(shielded, "component", "left_anti").orderBy("area", "gap_p05", "component").limit(top)


def remnants(tri: DataFrame, comp: DataFrame, cells: DataFrame, size: float, floor: float = 0.0, cap: float = 255.0) -> DataFrame:
    """(component, faces, area) of the faces that no mask takes and no mask's ground band keeps.

    A face is probed at its corners and its middle against all masks; one probe held by one mask is enough to take it
    out, and one on preserved ground, if the face is flat, to keep it out of the report.
    """
    flat = F.abs(normalise(face_normal())[1])
    corners = [F.struct(*[F.col(f"{a}{i}").alias(a) for a in "xyz"]) for i in (1, 2, 3)]
    middle = F.struct(*[((F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 3).alias(a) for a in "xyz"])
    probes = tri.select("tile_id", "tri_idx", flat.alias("ny"), F.inline(F.array(*corners, middle)))
    met = raster.mask_samples(probes, cells, size).where(raster.mask_hit(floor=floor, cap=cap) | raster.preserved_ground())
    rest = tri.join(met.select("tile_id", "tri_idx").distinct(), ["tile_id", "tri_idx"], "left_anti").join(comp, "tri_idx")
    return rest.groupBy("component").agg(F.count("*").alias("faces"), F.round(F.sum(face_area()), 6).alias("area"))


def identity_audit(edges: DataFrame, step: float, overlap_limit: float = 0.005) -> DataFrame:
    """Pairs of domains that share more than the allowed part of the smaller one, by cells of the given step."""
    cells = raster.cells_in_polygons(edges, step)
    m = raster.overlap_match(cells.withColumnRenamed("poly_id", "a_id"), cells.withColumnRenamed("poly_id", "b_id"), 0.0).where("a_id < b_id")
    return m.withColumn("share", F.greatest("ratio_a", "ratio_b")).where(F.col("share") > overlap_limit).select("a_id", "b_id", "shared", "share")


def normalise_footprints(edges: DataFrame, min_part: float = 5.0, min_hole: float = 9.0) -> DataFrame:
    """Change log: parts and holes too small to keep, with their area."""
    rings = polygons.signed_ring_area(edges).withColumn("area", F.abs("signed_area"))
    small = ((F.col("ring") == 0) & (F.col("area") <= min_part)) | ((F.col("ring") > 0) & (F.col("area") <= min_hole))
    return rings.where(small).select("poly_id", "part", "ring", F.when(F.col("ring") == 0, "small-part-dropped").otherwise("small-hole-filled").alias("change"), "area")


def terrain_check(cells: DataFrame, tri: DataFrame) -> DataFrame:
    """One row: vertices used that are no source cell, invalid cells used, faces not facing up."""
    at = F.array(*[F.struct(F.col(f"r{i}").alias("row_no"), F.col(f"c{i}").alias("col_no"), F.col(f"y{i}").alias("y")) for i in (1, 2, 3)])
    v = tri.select(F.inline(at))
    j = v.join(cells.select("row_no", "col_no", "h"), ["row_no", "col_no"], "left")
    bad = j.agg(F.count("*").alias("corners"), F.count(F.when(F.col("h").isNull(), 1)).alias("unsupported"), F.coalesce(F.max(F.abs(F.col("y") - F.col("h"))), F.lit(0.0)).alias("max_error"))
    return bad.crossJoin(tri.agg(F.count("*").alias("faces"), F.count(F.when(F.col("ny") <= 0, 1)).alias("not_upward")))  # one row each


def seal_check(sealed: DataFrame, present: DataFrame) -> DataFrame:
    """Verdict per path of a sealed inventory against what is there."""
    return linkage.inventory_diff(sealed, present, "path", ["bytes", "sha256"]).groupBy("change").agg(F.count("*").alias("paths"))


def catalogue_rows(df: DataFrame, rules: list[tuple[str, str]], positions: DataFrame) -> DataFrame:
    """First matching category per row and whether a position is known."""
    c = None
    for cat, test in rules:
        c = F.when(F.expr(test), cat) if c is None else c.when(F.expr(test), cat)
    return df.withColumn("category", c.otherwise("other")).join(positions.withColumn("located", F.lit(True)), "id", "left").withColumn("located", F.coalesce("located", F.lit(False)))
