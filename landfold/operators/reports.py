"""Reports over the registry, the inventories and the terrain, each built from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import face_normal
from landfold.functions.text import HAN, display_name, normalize_search, search_names
from landfold.operators import linkage, mesh, raster, summaries
from landfold.operators.frames import pixel_rays
from landfold.operators.polygons import point_in_polygon
from landfold.operators.scoring import bound_ids
from landfold.plans.ordered import quantiles
from landfold.session import cut_lineage


def search_rooms(asks: DataFrame, index: DataFrame, drawn: DataFrame) -> DataFrame:
    """(ask_id, room_id, name, from_index) of the rooms of a building that answer each ask.

    asks: ask_id, building, text; index: room_id, building, name, type; drawn: room_id, building, name, interactive. With
    a text, the rooms of the index whose name or type holds it; without one, the rooms that are drawn and interactive.
    Asks meet only the rooms of their building.
    """
    asked = asks.withColumn("wanted", F.lower(F.coalesce("text", F.lit(""))))
    blank = F.trim("wanted") == ""
    found = asked.where(~blank).join(index, "building").where(F.lower(F.concat_ws(" ", "name", "type")).contains(F.col("wanted")))
    listed = asked.where(blank).join(drawn.where(F.coalesce("interactive", F.lit(True))), "building")
    cols = ["ask_id", "room_id", "name"]
    return found.select(*cols, F.lit(True).alias("from_index")).unionByName(listed.select(*cols, F.lit(False).alias("from_index")))


def negative_bindings(services: DataFrame, entities: DataFrame, uses: dict[str, DataFrame]) -> DataFrame:
    """(entity_id, rule, n): services that must stand for themselves nowhere, and what they have all the same.

    services: entity_id, type, parent_id as resolved; entities: entity_id, type, parent_id; uses: for each rule the table
    (entity_id) in which a service must not occur. unknown, wrong-type and wrong-parent compare with the registry.
    """
    held = services.select("entity_id", F.col("type").alias("want_type"), F.col("parent_id").alias("want_parent")).join(entities.select("entity_id", "type", "parent_id", F.lit(True).alias("there")), "entity_id", "left")
    there = F.coalesce("there", F.lit(False))
    wrong = F.array_compact(F.array(F.when(~there, "unknown"), F.when(there & ~F.col("type").eqNullSafe(F.col("want_type")), "wrong-type"), F.when(there & ~F.col("parent_id").eqNullSafe(F.col("want_parent")), "wrong-parent")))
    parts = [held.select("entity_id", F.explode(wrong).alias("rule"), F.lit(1).cast("bigint").alias("n"))]
    stacked = reduce(DataFrame.unionByName, [t.select("entity_id", F.lit(rule).alias("rule")) for rule, t in uses.items()])
    counted = stacked.groupBy("entity_id", "rule").agg(F.count("*").alias("n"))
    parts.append(counted.join(services.select("entity_id").distinct(), "entity_id", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def construction_bindings(works: DataFrame, documents: DataFrame, keys: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """(id, place, n): where an entity under construction is bound, though it must be nowhere.

    works: id; documents: name, doc (JSON in which one of the keys at any depth may name it; place is the document's
    name); tables: for each place a table (id). Each document is read once, and ids fold before they meet the works.
    """
    inside = documents.select("name", F.explode(bound_ids(F.col("doc"), keys)).alias("id")).groupBy("id", F.col("name").alias("place")).agg(F.count("*").alias("n"))
    stacked = [t.select("id", F.lit(place).alias("place")).groupBy("id", "place").agg(F.count("*").alias("n")) for place, t in tables.items()]
    return reduce(DataFrame.unionByName, [inside, *stacked]).join(works.select("id").distinct(), "id", "left_semi")


def inventory_report(catalog: DataFrame, classes: list[tuple[str, DataFrame]], picked: DataFrame, registry: DataFrame, most: int = 20) -> DataFrame:
    """(class, entries, picked, gap, unregistered, shown, first_missing): what of each class has no pick proof, and what the registry lacks.

    catalog: id; the first of the classes whose inventory holds an entry is its class; ids that only the registry has are
    of the class registry-only. shown counts gaps up to `most`; first_missing is the least id without a proof.
    """
    known = registry.select("id").distinct()
    classed = linkage.classify_inventory(catalog.select("id").distinct(), classes)
    flags = classed.join(picked.select("id").distinct().withColumn("is_picked", F.lit(True)), "id", "left").join(known.withColumn("is_known", F.lit(True)), "id", "left")
    extra = known.join(catalog.select("id"), "id", "left_anti").select("id", F.lit("registry-only").alias("class"), F.lit(None).cast("boolean").alias("is_picked"), F.lit(True).alias("is_known"))
    missing = F.when(F.col("is_picked").isNull(), F.col("id"))
    out = flags.unionByName(extra).groupBy("class").agg(
        F.count("*").alias("entries"), F.count("is_picked").alias("picked"), F.count(missing).alias("gap"), F.count(F.when(F.col("is_known").isNull(), 1)).alias("unregistered"), F.min(missing).alias("first_missing"))
    return out.withColumn("shown", F.least("gap", F.lit(most).cast("bigint")))


def consolidate_pois(pois: DataFrame, controls: DataFrame, outlines: DataFrame, trusted_rmse: float) -> DataFrame:
    """(id, source, e, n, caution, apart): one position for each point of interest.

    pois: id, sheet, x, y (map position, NULL if unknown); controls: sheet, x, y, e, n; outlines: id, e, n. The official
    outline's centre comes first, then the map position through its sheet's affine fit; what has neither is unresolved.
    caution: the fit's RMSE where the fit is used and worse than trusted_rmse; apart: how far the fit lies from the outline
    where both are known. A sheet of fewer than three controls or with all on a line has no fit.
    """
    fit = summaries.fit_affine(controls, "sheet")
    mean = controls.groupBy("sheet").agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "e", "n")])
    placed = pois.join(fit.join(mean, "sheet").where("ae is not null"), "sheet", "left")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    placed = placed.select("id", (F.col("me") + F.col("ae") * dx + F.col("be") * dy).alias("fit_e"), (F.col("mn") + F.col("an") * dx + F.col("bn") * dy).alias("fit_n"), "rmse")
    j = placed.join(outlines.select("id", F.col("e").alias("out_e"), F.col("n").alias("out_n")), "id", "left")
    official, guessed = F.col("out_e").isNotNull(), F.col("fit_e").isNotNull()
    de, dn = F.col("fit_e") - F.col("out_e"), F.col("fit_n") - F.col("out_n")
    return j.select("id", F.when(official, "official-outline").when(guessed, "map-estimate").otherwise("unresolved").alias("source"), F.coalesce("out_e", "fit_e").alias("e"), F.coalesce("out_n", "fit_n").alias("n"),
                    F.when(~official & guessed & (F.col("rmse") > trusted_rmse), F.col("rmse")).alias("caution"), F.sqrt(de * de + dn * dn).alias("apart"))


def terrain_report(tiles: DataFrame, cells: DataFrame, step: float, top: float, left: float, stride: int) -> DataFrame:
    """One row: the terrain built from its tiles, and what a grid of `stride` times the step loses.

    tiles and cells as for raster.mosaic(). vertices, faces and faces up of the full grid; then of the coarse one; and at
    the full grid's vertices inside the coarse one the error of its faces: points, bias, rmse, p95_abs, max_abs.
    """
    grid = cut_lineage(raster.mosaic(tiles, cells, step, top, left))
    size = grid.agg(F.max("row_no").alias("rows"), F.max("col_no").alias("cols")).first()
    coarse = cut_lineage(raster.downsample(grid, stride))
    counts = []
    for name, g, s in (("", grid, step), ("coarse_", coarse, step * stride)):
        faces = raster.triangulate(g, s).agg(F.count("*").alias(f"{name}faces"), F.count(F.when(face_normal()[1] > 0, 1)).alias(f"{name}upward"))
        counts.append(g.agg(F.count("h").alias(f"{name}vertices")).crossJoin(faces))  # one row each
    at = grid.where("h is not null").select(F.struct("row_no", "col_no").alias("pt_id"), (F.col("col_no") * step).alias("x"), (F.col("row_no") * step).alias("z"), F.col("h").alias("truth"))
    rows, columns = ((int(v) // stride + 1 if v is not None else 0) for v in (size["rows"], size["cols"]))
    seen = at.join(raster.sample_dem(at, coarse, step * stride, rows, columns, "triangle"), "pt_id").where("h is not null").select((F.col("h") - F.col("truth")).alias("off"), F.abs(F.col("h") - F.col("truth")).alias("gap"))
    seen = cut_lineage(seen)
    error = seen.agg(F.count("*").alias("points"), F.avg("off").alias("bias"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rmse"), F.max("gap").alias("max_abs"))
    out = reduce(DataFrame.crossJoin, [*counts, error])  # one row each
    return out.join(quantiles(seen, [], "gap", [0.95], ["p95_abs"]), F.lit(True), "left")


LOCALES = ("en", "zh-Hant", "zh-Hans")


def locale_report(entities: DataFrame, messages: DataFrame) -> DataFrame:
    """(rule, locale, key): what is not translated, cannot be told apart or cannot be searched for.

    entities: entity_id, name, aliases; messages: locale, key. empty-name, placeholder, han-in-english and no-han: the name
    shown in a locale; shared-name: one that several entities show (key: the name); search-misses: an entity of which a
    shown name, normalised as a query, is not among its normalised search names or is empty; key-missing: a message key that another locale has.
    """
    shown = F.array(*[F.struct(F.lit(loc).alias("locale"), display_name("name", "aliases", loc).alias("shown")) for loc in LOCALES])
    names = F.transform(search_names("name", "aliases"), normalize_search)
    each = entities.select("entity_id", names.alias("names"), F.inline(shown))
    s, han = F.coalesce("shown", F.lit("")), F.col("shown").rlike(HAN)
    wanted = normalize_search(s)
    wrong = F.array_compact(F.array(
        F.when(F.trim(s) == "", "empty-name"), F.when(s.rlike("[{}]"), "placeholder"), F.when((F.col("locale") == "en") & han, "han-in-english"),
        F.when((F.col("locale") != "en") & ~han, "no-han"), F.when((wanted == "") | ~F.array_contains("names", wanted), "search-misses")))
    single = each.select(F.explode(wrong).alias("rule"), "locale", F.col("entity_id").alias("key"))
    shared = each.groupBy("locale", "shown").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi")).where("lo <> hi").select(F.lit("shared-name").alias("rule"), "locale", F.col("shown").alias("key"))
    have = messages.select("locale", "key").distinct()
    want = have.select("key").distinct().withColumn("locale", F.explode(F.array(*[F.lit(x) for x in LOCALES])))
    missing = want.join(have, ["locale", "key"], "left_anti").select(F.lit("key-missing").alias("rule"), "locale", "key")
    return single.unionByName(shared).unionByName(missing)


def identity_report(edges: DataFrame, identities: DataFrame, labels: DataFrame, step: float, overlap_limit: float = 0.005) -> DataFrame:
    """(rule, entity_id, other, value): identities whose drawn fragments do not hold their label, lie on each other or overlap another identity.

    identities: poly_id, entity_id (fragments of one identity); labels: entity_id, x, z. label-outside: a label that lies
    in no fragment, with the number of fragments; fragments-overlap: square metres that several fragments of one identity
    cover, counted beyond the first; identities-overlap: the shared part of the smaller one's union, above the limit.
    Areas are of cell centres.
    """
    cells = cut_lineage(raster.cells_in_polygons(edges, step).join(identities, "poly_id").groupBy("entity_id", "row_no", "col_no").agg(F.count("*").alias("n")))
    double = cells.groupBy("entity_id").agg(F.sum(F.col("n") - 1).alias("twice")).where("twice > 0").select(
        F.lit("fragments-overlap").alias("rule"), "entity_id", F.lit(None).cast("string").alias("other"), (F.col("twice") * F.lit(step * step)).alias("value"))
    a, b = (cells.select(F.col("entity_id").alias(f"{x}_id"), "row_no", "col_no") for x in "ab")
    met = a.join(b, ["row_no", "col_no"]).where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
    size = cells.groupBy("entity_id").agg(F.count("*").alias("cells"))
    share = met.join(size.select(F.col("entity_id").alias("a_id"), F.col("cells").alias("na")), "a_id").join(size.select(F.col("entity_id").alias("b_id"), F.col("cells").alias("nb")), "b_id")
    share = share.withColumn("value", F.col("shared") / F.least("na", "nb")).where(F.col("value") > overlap_limit)
    cross = share.select(F.lit("identities-overlap").alias("rule"), F.col("a_id").alias("entity_id"), F.col("b_id").alias("other"), "value")
    spots = labels.select(F.struct("entity_id", "x", "z").alias("pt_id"), "x", "z")
    inside = point_in_polygon(spots, edges).join(identities, "poly_id").where("pt_id.entity_id = entity_id").select("pt_id").distinct().withColumn("held", F.lit(True))
    fragments = identities.groupBy("entity_id").agg(F.count("*").cast("double").alias("value"))
    loose = spots.join(inside, "pt_id", "left").where("held is null").select("pt_id.entity_id").join(fragments, "entity_id", "left")
    outside = loose.select(F.lit("label-outside").alias("rule"), "entity_id", F.lit(None).cast("string").alias("other"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return outside.unionByName(double).unionByName(cross)


def viewport_audit(poses: DataFrame, tri: DataFrame, comp: DataFrame, cells: DataFrame, size: float, floor: float, cap: float, reach: float, width: int, height: int, fov_degrees: float, cols: tuple[int, int], rows: tuple[int, int]) -> DataFrame:
    """(component, hits, faces): what the pixels of some views see first, once the hits that a mask holds are looked through.

    poses: pose_id, ex..ez, fx..fz. Each pixel of the region is a ray from its view.
    """
    rays = pixel_rays(poses, width, height, fov_degrees, cols, rows).join(poses.select("pose_id", *[F.col(f"e{a}").alias(f"o{a}") for a in "xyz"]), "pose_id")
    rays = rays.select(F.struct("pose_id", "row_no", "col_no").alias("ray_id"), *[f"{n}{a}" for n in "od" for a in "xyz"])
    hits = cut_lineage(mesh.ray_hits(rays, tri, reach))
    at = hits.select("ray_id", "tri_idx", "dist").join(rays, "ray_id").select(F.struct("ray_id", "tri_idx").alias("pt_id"), *[(F.col(f"o{a}") + F.col(f"d{a}") * F.col("dist")).alias(a) for a in "xyz"])
    held = raster.mask_samples(at, cells, size).where(raster.mask_hit(floor=floor, cap=cap)).select("pt_id.*").distinct()
    return mesh.hit_histogram(mesh.first_hit(hits.join(held, ["ray_id", "tri_idx"], "left_anti")), comp)
