"""Cell tables: terrain grids (row_no, col_no, h) and masks (mask_id, row_no, col_no, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import barycentric_xz, cell_of, col, crosses_ray, face_normal, normalise
from landfold.operators.polygons import BAND, EDGE, SLAB, _slab, point_in_polygon, ring_boxes, slab_edges
from landfold.plans.gridjoin import spread
from landfold.plans.ordered import quantiles, running


def mosaic(tiles: DataFrame, cells: DataFrame, pixel: float, top: float, left: float) -> DataFrame:
    """Tile cells on one lattice by each tile's corner (north, east); the later tile wins, no-data included."""
    placed = cells.join(tiles, "tile_id").select(
        (F.rint((F.lit(top) - F.col("north")) / pixel).cast("bigint") + F.col("r")).alias("row_no"),
        (F.rint((F.col("east") - F.lit(left)) / pixel).cast("bigint") + F.col("c")).alias("col_no"), "ord", "h",
    )
    return placed.groupBy("row_no", "col_no").agg(F.max_by("h", "ord").alias("h"))


def tile_grid(cells: DataFrame, n: int = 250, halo: int = 1) -> DataFrame:
    """Cells assigned to n×n tiles, each tile also getting the halo cells around it."""
    lo = lambda c: F.floor((F.col(c) - halo) / n)
    hi = lambda c: F.floor((F.col(c) + halo) / n)
    out = cells.withColumn("tile_row", F.explode(F.sequence(lo("row_no"), hi("row_no")))).withColumn(
        "tile_col", F.explode(F.sequence(lo("col_no"), hi("col_no"))))
    own = (F.floor(F.col("row_no") / n) == F.col("tile_row")) & (F.floor(F.col("col_no") / n) == F.col("tile_col"))
    return out.withColumn("core", own)


def tile_summary(tiled: DataFrame) -> DataFrame:
    """Per tile that owns any cell: core and halo cells, valid heights, and whether it is skipped as empty."""
    return tiled.groupBy("tile_row", "tile_col").agg(
        F.count(F.when(F.col("core"), 1)).alias("core_cells"), F.count(F.when(~F.col("core"), 1)).alias("halo_cells"),
        F.count(F.when(F.col("core"), F.col("h"))).alias("valid"),
    ).where("core_cells > 0").withColumn("skipped", F.col("valid") == 0)


def tile_violations(tiles: DataFrame, cells: DataFrame, n: int = 250, halo: int = 1, limit: float = 0.0) -> DataFrame:
    """(rule, tile_row, tile_col, row_no, col_no, difference): exported tiles against the grid they were cut from, and against each other.

    cell-differs and no-data-differs: a tile's cell and the source's; outside-grid: a cell that the source does not have;
    not-in-tile: a cell that lies neither in its tile nor in the halo; seam-differs: a cell that several tiles hold with
    different heights (at the tile that owns it); cell-missing: a valid cell of the source that no tile owns. Cells meet
    once on (row_no, col_no); a cell lies in four tiles at most.
    """
    n_, at = F.lit(n), ["row_no", "col_no"]
    home = [F.floor(F.col(c) / n_).cast("bigint") for c in at]
    source = cells.select(*at, F.col("h").alias("truth"), F.lit(True).alias("known"))
    held = tiles.select(*at, "tile_row", "tile_col", "core", "h").join(source, at, "full")
    off = F.abs(F.col("h") - F.col("truth"))
    inside = [F.col(c).between(F.col(t) * n - halo, (F.col(t) + 1) * n - 1 + halo) for c, t in zip(at, ("tile_row", "tile_col"))]
    found = F.col("tile_row").isNotNull()
    rule = (F.when(found & F.col("known").isNull(), "outside-grid").when(found & ~(inside[0] & inside[1]), "not-in-tile")
            .when(found & (F.col("h").isNull() != F.col("truth").isNull()), "no-data-differs").when(found & (off > limit), "cell-differs"))
    single = held.select(rule.alias("rule"), "tile_row", "tile_col", *at, off.alias("difference")).where("rule is not null")
    spread = held.groupBy(*at).agg(F.max("truth").alias("truth"), F.max("h").alias("hi"), F.min("h").alias("lo"), F.max(F.coalesce("core", F.lit(False))).alias("owned"))
    seam = spread.where(F.col("hi") - F.col("lo") > limit).select(F.lit("seam-differs").alias("rule"), home[0].alias("tile_row"), home[1].alias("tile_col"), *at, (F.col("hi") - F.col("lo")).alias("difference"))
    lost = spread.where("truth is not null and not owned").select(F.lit("cell-missing").alias("rule"), home[0].alias("tile_row"), home[1].alias("tile_col"), *at, F.lit(None).cast("double").alias("difference"))
    return single.unionByName(seam).unionByName(lost)


def sample_dem(points: DataFrame, dem: DataFrame, step: float, rows: int, columns: int, mode: str = "bilinear", name: str = "h") -> DataFrame:
    """Height at each point (pt_id, x, z) from its four cell corners; NULL outside or next to no-data.

    bilinear, or triangle: the NW/NE/SW face where u + v <= 1, else NE/SW/SE.
    """
    c, r = F.col("x") / step, F.col("z") / step
    inside = (c >= 0) & (r >= 0) & (c <= columns - 1) & (r <= rows - 1)
    p = points.select("pt_id", "x", "z").withColumns({
        "c0": F.when(inside, F.least(F.floor(c).cast("bigint"), F.lit(columns - 2))), "r0": F.when(inside, F.least(F.floor(r).cast("bigint"), F.lit(rows - 2)))})
    p = p.withColumns({"u": F.col("x") / step - F.col("c0"), "v": F.col("z") / step - F.col("r0")})
    # the corners of each cell that holds a point are brought together once, however many points it holds
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("r0") + dr).alias("row_no"), (F.col("c0") + dc).alias("col_no")) for k, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))])
    keys = p.select("r0", "c0").where("r0 is not null").distinct().select("r0", "c0", F.inline(offsets))
    got = keys.join(dem.select("row_no", "col_no", F.col("h").alias("corner")).where("corner is not null"), ["row_no", "col_no"])
    cell = got.groupBy("r0", "c0").agg(*[F.max(F.when(F.col("k") == k, F.col("corner"))).alias(n) for k, n in enumerate("abde")], F.count("*").alias("n")).where("n = 4")
    u, v, a, b, d, e = (F.col(n) for n in "uvabde")
    if mode == "bilinear":
        h = (a * (F.lit(1.0) - u) + b * u) * (F.lit(1.0) - v) + (d * (F.lit(1.0) - u) + e * u) * v
    else:
        h = F.when(u + v <= 1, a + (b - a) * u + (d - a) * v).otherwise(e + (d - e) * (F.lit(1.0) - u) + (b - e) * (F.lit(1.0) - v))
    return p.join(cell, ["r0", "c0"], "left").select("pt_id", h.alias(name))


def surface_at(points: DataFrame, floors: DataFrame, fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Surface under each point: indoor floor, fine grid, coarse grid, known water (0), else unknown.

    floors: pt_id, floor_y of every floor plane around the point; fine and coarse: pt_id, h.
    The floor is the highest plane not above the point, or the lowest when all are above.
    """
    reach = F.col("floor_y") <= F.col("y") + 1e-4
    indoor = floors.join(points.select("pt_id", "y"), "pt_id").groupBy("pt_id").agg(
        F.coalesce(F.max(F.when(reach, F.col("floor_y"))), F.min("floor_y")).alias("indoor"))
    joined = points.select("pt_id", "water").join(indoor, "pt_id", "left").join(
        fine.select("pt_id", F.col("h").alias("fine")), "pt_id", "left").join(coarse.select("pt_id", F.col("h").alias("coarse")), "pt_id", "left")
    water = F.when(F.col("water"), F.lit(0.0))
    source = (F.when(F.col("indoor").isNotNull(), "indoor").when(F.col("fine").isNotNull(), "detail").when(F.col("coarse").isNotNull(), "terrain")
              .when(F.col("water"), "water").otherwise("unknown"))
    return joined.select("pt_id", F.coalesce("indoor", "fine", "coarse", water).alias("height"), source.alias("source"))


def downsample(cells: DataFrame, stride: int) -> DataFrame:
    """Sample at the block corner, only where every cell of the whole block is present and valid."""
    block = cells.groupBy(F.floor(F.col("row_no") / stride).alias("row_no"), F.floor(F.col("col_no") / stride).alias("col_no")).agg(
        F.count("h").alias("valid"), F.max(F.when((F.col("row_no") % stride == 0) & (F.col("col_no") % stride == 0), F.col("h"))).alias("corner"))
    return block.select("row_no", "col_no", F.when(F.col("valid") == stride * stride, F.col("corner")).alias("h"))


def extrema(cells: DataFrame) -> DataFrame:
    at = F.struct("row_no", "col_no")
    agg = cells.where("h is not null").agg(
        F.min("h").alias("low"), F.min_by(at, F.struct("h", at)).alias("a"), F.max("h").alias("high"), F.min_by(at, F.struct(-F.col("h"), at)).alias("b"))
    return agg.select("low", F.col("a.row_no").alias("low_row"), F.col("a.col_no").alias("low_col"), "high", F.col("b.row_no").alias("high_row"), F.col("b.col_no").alias("high_col"))


def triangulate(cells: DataFrame, step: float) -> DataFrame:
    """Two triangles (NW SW NE, NE SW SE) per cell with four valid corners.

    Each height is sent to the four cells it is a corner of, so one shuffle replaces three self joins.
    """
    valid = cells.where("h is not null")
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))])
    sent = valid.select("row_no", "col_no", "h", F.inline(shifts)).select(
        (F.col("row_no") - F.col("dr")).alias("row_no"), (F.col("col_no") - F.col("dc")).alias("col_no"), "k", "h")
    four = sent.groupBy("row_no", "col_no").agg(*[F.max(F.when(F.col("k") == k, F.col("h"))).alias(n) for k, n in enumerate(("nw", "ne", "sw", "se"))], F.count("*").alias("n")).where("n = 4")
    x0, z0 = F.col("col_no") * F.lit(float(step)), F.col("row_no") * F.lit(float(step))
    x1, z1 = (F.col("col_no") + 1) * F.lit(float(step)), (F.col("row_no") + 1) * F.lit(float(step))
    at = {"nw": (x0, F.col("nw"), z0), "ne": (x1, F.col("ne"), z0), "sw": (x0, F.col("sw"), z1), "se": (x1, F.col("se"), z1)}

    def face(k, names):
        return F.struct(F.lit(k).alias("half"), *[v.alias(f"{a}{i + 1}") for i, n in enumerate(names) for a, v in zip("xyz", at[n])])

    return four.select("row_no", "col_no", F.inline(F.array(face(0, ("nw", "sw", "ne")), face(1, ("ne", "sw", "se")))))


def vertex_normals(tri: DataFrame, digits: int = 6) -> DataFrame:
    """Area-weighted unit normal per vertex position."""
    n = dict(zip(("nx", "ny", "nz"), face_normal()))
    corners = F.array(*[F.struct(*[F.col(f"{a}{i}").alias(a) for a in "xyz"]) for i in (1, 2, 3)])
    v = tri.select(*[c.alias(k) for k, c in n.items()], F.inline(corners))
    total = v.groupBy("x", "y", "z").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"), F.sum("nz").alias("nz"))
    unit = normalise((F.col("nx"), F.col("ny"), F.col("nz")))
    return total.select("x", "y", "z", *[F.round(c, digits).alias(k) for k, c in zip(("nx", "ny", "nz"), unit)])


def error_stats(df: DataFrame, estimate: str, truth: str) -> DataFrame:
    """Signed mean, MAE, RMSE, exact p50/p95/p99 and maximum of the absolute error, over rows that have both."""
    e = df.select((F.col(estimate) - F.col(truth)).alias("e")).where("e is not null").withColumn("a", F.abs("e"))
    flat = e.agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.avg("a").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.max("a").alias("max"))
    q = quantiles(e, [], "a", [0.5, 0.95, 0.99], ["p50", "p95", "p99"])
    # One row on either side.
    return flat.crossJoin(q).select("n", *[F.round(c, 9).alias(c) for c in ("mean", "mae", "rmse", "p50", "p95", "p99")], "max")


def profile(df: DataFrame, value: str, ps=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Count, extremes and quantiles as (stat, value) rows, then a one-unit histogram."""
    v = df.select(F.col(value).alias("v")).where("v is not null and not isnan(v)")
    s = v.agg(F.count("*").cast("double").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"))
    names = [f"p{round(p * 100):02d}" for p in ps]
    q = quantiles(v, [], "v", list(ps), names)

    def melt(d, cols):
        return d.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.round(F.col(n), 9).alias("value")) for n in cols])))

    bins = v.groupBy(F.floor("v").alias("b")).agg(F.count("*").cast("double").alias("value"))
    return melt(s, ["count", "min", "max"]).unionByName(melt(q, names)).unionByName(
        bins.select(F.concat(F.lit("bin:"), F.col("b").cast("string")).alias("stat"), "value"))


# --- triangles on cells ---------------------------------------------------------

def triangles_to_cells(tri: DataFrame, step: float, eps: float = 1e-9) -> DataFrame:
    """Every cell centre inside each face (edges count) with the face's height there: no join, one row per hit."""
    def rng(axis):
        lo, hi = (f(*[F.col(f"{axis}{i}") for i in (1, 2, 3)]) for f in (F.least, F.greatest))
        return F.ceil(lo / step - 0.5 - eps).cast("bigint"), F.floor(hi / step - 0.5 + eps).cast("bigint")

    (c0, c1), (r0, r1) = rng("x"), rng("z")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b))
    t = tri.withColumn("col_no", F.explode(span(c0, c1))).withColumn("row_no", F.explode(span(r0, r1)))
    u, v, y = barycentric_xz((F.col("col_no") + 0.5) * step, (F.col("row_no") + 0.5) * step)
    t = t.withColumns({"u": u, "v": v, "y": y})
    return t.where((F.col("u") >= -eps) & (F.col("v") >= -eps) & (F.col("u") + F.col("v") <= 1 + eps)).select(
        "tile_id", "tri_idx", "row_no", "col_no", "y", F.abs(normalise(face_normal())[1]).alias("ny"))


def top_surface(hits: DataFrame, min_ny: float = 0.6) -> DataFrame:
    """Highest upward hit per cell with its witness face and the number of hits."""
    up = hits.where(F.col("ny") >= min_ny)
    return up.groupBy("row_no", "col_no").agg(
        F.max("y").alias("y"), F.min_by(F.struct("tile_id", "tri_idx"), F.struct(-F.col("y"), "tile_id", "tri_idx")).alias("w"), F.count("*").alias("hits"),
    ).select("row_no", "col_no", "y", F.col("w.tile_id").alias("tile_id"), F.col("w.tri_idx").alias("tri_idx"), "hits")


def matched_ground(hits: DataFrame, ground: DataFrame, limit: float = 1.0, min_ny: float = 0.6) -> DataFrame:
    """Per cell the upward hit nearest to the reference height, no farther than the limit."""
    near = hits.where(F.col("ny") >= min_ny).join(ground, ["row_no", "col_no"]).withColumn("delta", F.abs(F.col("y") - F.col("ground"))).where(F.col("delta") <= limit)
    return near.groupBy("row_no", "col_no").agg(F.min_by(F.struct("y", "tile_id", "tri_idx", "delta"), F.struct("delta", "tile_id", "tri_idx")).alias("w")).select("row_no", "col_no", "w.*")


def handoff_cells(tri: DataFrame, removed: DataFrame, step: float) -> DataFrame:
    """Cells covered by a removed face and by no retained one."""
    keys = removed.select("tile_id", "tri_idx")
    gone = triangles_to_cells(tri.join(keys, ["tile_id", "tri_idx"], "left_semi"), step).select("row_no", "col_no").distinct()
    kept = triangles_to_cells(tri.join(keys, ["tile_id", "tri_idx"], "left_anti"), step).select("row_no", "col_no")
    return gone.join(kept, ["row_no", "col_no"], "left_anti")


def claim_cells(cells: DataFrame) -> DataFrame:
    """Source of each cell: lowest error, ties by id."""
    return cells.groupBy("row_no", "col_no").agg(F.min_by("source_id", F.struct("error", "source_id")).alias("source_id"), F.min("error").alias("error"))


# --- masks ---------------------------------------------------------------------

def cells_in_polygons(edges: DataFrame, step: float, block: int = 64) -> DataFrame:
    """(poly_id, row_no, col_no) of the cell centres in each polygon, holes left out.

    An edge crosses the centre lines of some rows; a row's crossings, in order, are the ends of the spans inside, and only
    these are spread out: work grows with the edges and with the cells inside, not with the polygon's box. Long edges
    and wide spans are dealt out in blocks first. What is gathered is one row's crossings of one polygon.
    """
    centre = lambda c: (F.col(c) + 0.5) * step
    lo, hi = cell_of(F.least("z1", "z2"), step), cell_of(F.greatest("z1", "z2"), step)
    parts = edges.where("z1 <> z2").withColumn("rows_", F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block))))
    first, last = F.greatest(lo, F.col("rows_") * block), F.least(hi, (F.col("rows_") + 1) * block - 1)
    at = parts.withColumn("row_no", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).withColumn("z", centre("row_no"))
    at = at.where((F.col("z1") > F.col("z")) != (F.col("z2") > F.col("z")))
    cross = (F.col("x2") - F.col("x1")) * (F.col("z") - F.col("z1")) / (F.col("z2") - F.col("z1")) + F.col("x1")
    rows = at.groupBy("poly_id", "part", "row_no").agg(F.array_sort(F.collect_list(cross)).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("xs", 2 * k).alias("x0"), F.get("xs", 2 * k + 1).alias("x1")))
    spans = rows.where("size(xs) >= 2").select("poly_id", "row_no", F.inline(pairs)).where("x0 < x1")
    spans = spans.withColumns({"c0": cell_of("x0", step), "c1": cell_of("x1", step)}).withColumn("cols_", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor(F.col("c1") / block))))
    first, last = F.greatest("c0", F.col("cols_") * block), F.least("c1", (F.col("cols_") + 1) * block - 1)
    cells = spans.withColumn("col_no", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).withColumn("x", centre("col_no"))
    return cells.where("x >= x0 and x < x1").select("poly_id", "row_no", "col_no").distinct()


def coverage(domain_cells: DataFrame, covered: DataFrame) -> DataFrame:
    """Share of each domain's cells that each covering level has. covered: level, row_no, col_no."""
    size = domain_cells.groupBy("poly_id").agg(F.count("*").alias("cells"))
    hit = domain_cells.join(spread(covered.distinct()), ["row_no", "col_no"]).groupBy("poly_id", "level").agg(F.count("*").alias("covered"))
    return hit.join(size, "poly_id").withColumn("ratio", F.col("covered") / F.col("cells"))


def overlap_match(a_cells: DataFrame, b_cells: DataFrame, least: float = 0.1) -> DataFrame:
    """(a_id, b_id) sharing cells, with the share of each side; kept from the least share of either."""
    shared = a_cells.join(spread(b_cells), ["row_no", "col_no"]).groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
    na = a_cells.groupBy("a_id").agg(F.count("*").alias("na"))
    nb = b_cells.groupBy("b_id").agg(F.count("*").alias("nb"))
    out = shared.join(na, "a_id").join(nb, "b_id").withColumns({"ratio_a": F.col("shared") / F.col("na"), "ratio_b": F.col("shared") / F.col("nb")})
    return out.where(F.greatest("ratio_a", "ratio_b") >= least).withColumn("owned", (F.col("ratio_a") > 0.96) & (F.col("ratio_b") > 0.93))


def union_area(cells: DataFrame, key: str, pixel: str) -> DataFrame:
    """Area of the union of each key's masks: distinct cells times pixel²; mixed pixel sizes give NULL."""
    one = cells.groupBy(key, "row_no", "col_no").agg(F.min(pixel).alias("lo"), F.max(pixel).alias("hi"))
    out = one.groupBy(key).agg(F.count("*").alias("pixels"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select(key, "pixels", F.when(F.col("lo") == F.col("hi"), F.col("pixels") * F.col("lo") * F.col("lo")).alias("area"))


def mask_or(cells: DataFrame, masks: DataFrame, most_cells: int | None = None) -> DataFrame:
    """(row_no, col_no) of the union of set cells, counted in steps of the finest mask from the common corner.

    masks: mask_id, min_x, min_z, step. Every mask must lie on the finest lattice. most_cells, if given, bounds the union.
    """
    finest = masks.agg(F.min("step").alias("fine"), F.min("min_x").alias("west"), F.min("min_z").alias("north"))
    steps = masks.crossJoin(F.broadcast(finest)).select(  # one row
        "mask_id", ((F.col("min_x") - F.col("west")) / F.col("fine")).alias("dx"), ((F.col("min_z") - F.col("north")) / F.col("fine")).alias("dz"), (F.col("step") / F.col("fine")).alias("k"))
    apart = steps.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.rint(c)) for c in ("dx", "dz", "k")]))).first()[0]
    if (apart or 0.0) > 1e-6:
        raise ValueError(f"a mask lies {apart} of a step off the finest lattice")
    whole = steps.select("mask_id", *[F.rint(c).cast("bigint").alias(c) for c in ("dx", "dz", "k")])
    span = F.sequence(F.lit(0), F.col("k") - 1)
    spread = cells.join(whole, "mask_id").withColumn("down", F.explode(span)).withColumn("right", F.explode(span))
    union = spread.select((F.col("dz") + F.col("row_no") * F.col("k") + F.col("down")).alias("row_no"), (F.col("dx") + F.col("col_no") * F.col("k") + F.col("right")).alias("col_no")).distinct()
    if most_cells is not None and union.count() > most_cells:
        raise ValueError(f"the union has more than {most_cells} cells")
    return union


def mask_merge(cells: DataFrame, guards: DataFrame) -> DataFrame:
    """Per cell the greatest upper limit (65535 for a handoff pixel) and the least lower guard.

    guards: mask_id, min_y, max_y, encoded (does alpha hold a lower guard). A guard at the common floor is written as 255.
    """
    floor = guards.agg(F.min("min_y").alias("common"))
    c = cells.where("r > 127").join(guards, "mask_id")
    upper = F.when((F.col("g") == 0) & (F.col("b") == 0), F.lit(65535)).otherwise(F.rint(F.col("max_y") * 256).cast("int"))
    lower = F.when(F.col("encoded") & (F.col("a") < 255), F.greatest("min_y", F.col("a").cast("double"))).otherwise(F.col("min_y"))
    out = c.groupBy("row_no", "col_no").agg(F.max(upper).alias("upper"), F.min(lower).alias("lower"))
    common = floor.first()["common"]
    return out.select("row_no", "col_no", "upper", F.when(F.col("lower") > common, F.floor("lower").cast("int")).otherwise(255).alias("lower"))


def mask_samples(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Mask values under each point, one row per mask with a cell there."""
    at = points.withColumns({"row_no": cell_of("z", size), "col_no": cell_of("x", size)})
    return at.join(cells, ["row_no", "col_no"])


def preserved_ground(y="y", ny="ny", band: float = 1.25) -> Column:
    return (F.col("r") > 127) & (F.abs(col(y) - F.col("g") - F.col("b") / 256) <= band) & (col(ny) >= 0.6)


def mask_hit(y="y", floor: float = 0.0, cap: float = 255.0) -> Column:
    """Is the point held by the mask: set, above its lower guard (alpha 255 means the common floor), not above the cap."""
    guard = F.when(F.col("a") == 255, F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.col("a").cast("double")))
    return (F.col("r") > 127) & (col(y) >= guard) & (col(y) <= cap)


def preserved_structure(points: DataFrame, cells: DataFrame, edges: DataFrame, size: float, band: float = 1.0) -> DataFrame:
    """Points kept by a protection mask: in its ground band on a flat face, or in its height interval inside the drawing."""
    inside = point_in_polygon(points, edges, "include_all").select("pt_id").distinct().withColumn("drawn", F.lit(True))
    s = mask_samples(points, cells, size).join(inside, "pt_id", "left")
    ground = (F.col("r") > 0) & (F.abs(F.col("y") - F.col("r") - F.col("g") / 256) <= band) & (F.col("ny") >= 0.6)
    held = (F.col("b") < 255) & (F.col("a") < 255) & F.col("y").between(F.col("b"), F.col("a")) & F.coalesce("drawn", F.lit(False))
    return s.where(ground | held).select("pt_id", ground.alias("by_ground"), held.alias("by_structure"))


def visible_points(points: DataFrame, cells: DataFrame, rules: DataFrame, size: float, ground_mask: int, band: float = 1.25) -> DataFrame:
    """Points that no enabled mask of their role discards.

    rules: role, mask_id, min_y, max_y, replacement, encoded, clearance. A replacement mask
    spares preserved ground; an encoded mask discards only flat faces up to its height.
    """
    s = mask_samples(points, cells, size)
    kept = s.where(F.col("mask_id") == ground_mask).where(preserved_ground(band=band)).select("pt_id").distinct().withColumn("kept", F.lit(True))
    hit = s.join(rules, ["role", "mask_id"]).where((F.col("r") > 127) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    hit = hit.where(~F.col("encoded") | ((F.col("y") <= F.col("g") + F.col("b") / 256 + F.col("clearance")) & (F.col("ny") >= 0.6)))
    discarded = hit.join(kept, "pt_id", "left").where(~F.col("replacement") | F.col("kept").isNull())
    return points.join(discarded.select("pt_id"), "pt_id", "left_anti")


def dilate(cells: DataFrame, reach: int = 1) -> DataFrame:
    """Cells within the reach in both directions."""
    span = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
    return cells.withColumn("row_no", span("row_no")).withColumn("col_no", span("col_no")).select("row_no", "col_no").distinct()


def guarded(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Dilated child mask clamped to its parent: green never exceeds red."""
    wide = dilate(child).withColumn("g", F.lit(255))
    return parent.join(wide, ["row_no", "col_no"], "left").select("row_no", "col_no", "r", F.least("r", F.coalesce("g", F.lit(0))).alias("g"))


def merge_intervals(df: DataFrame, keys: list[str], gap: float = 0.02) -> DataFrame:
    """Intervals lo..hi joined where no wider gap parts them; returns key, island, lo, hi, faces."""
    w = running(df, keys, ["lo", "hi"], {"reach": ("max", "hi")}, exclusive=True)
    w = w.withColumn("starts", (F.col("reach").isNull() | (F.col("lo") > F.col("reach") + gap)).cast("int"))
    w = running(w, keys, ["lo", "hi"], {"island": ("sum", "starts")})
    return w.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("faces"))


def widest_interval(islands: DataFrame, keys: list[str]) -> DataFrame:
    """The widest island per key (the first of equals) and whether there was a choice."""
    return islands.groupBy(*keys).agg(
        F.min_by(F.struct("lo", "hi"), F.struct(F.col("lo") - F.col("hi"), "lo")).alias("p"), (F.count("*") > 1).alias("ambiguous")).select(*keys, "p.lo", "p.hi", "ambiguous")


def raster_diff(a: DataFrame, b: DataFrame, region: Column) -> DataFrame:
    """Per region: mean absolute difference, shares above 15 and 30, correlation of the eastward gradients."""
    def grad(df, v, g):
        nxt = df.select("row_no", (F.col("col_no") - 1).alias("col_no"), F.col("h").alias("east"))
        return df.join(nxt, ["row_no", "col_no"], "left").select("row_no", "col_no", F.col("h").alias(v), (F.col("east") - F.col("h")).alias(g))

    j = grad(a, "va", "ga").join(grad(b, "vb", "gb"), ["row_no", "col_no"]).withColumn("region", region).withColumn("d", F.abs(F.col("va") - F.col("vb")))
    both = F.col("ga").isNotNull() & F.col("gb").isNotNull()
    ga, gb = F.when(both, F.col("ga")), F.when(both, F.col("gb"))
    flat = (F.stddev_pop(ga) == 0) | (F.stddev_pop(gb) == 0)
    return j.groupBy("region").agg(
        F.count("d").alias("cells"), F.round(F.avg("d"), 9).alias("mean_abs"), F.round(F.avg((F.col("d") > 15).cast("double")), 9).alias("over15"),
        F.round(F.avg((F.col("d") > 30).cast("double")), 9).alias("over30"), F.round(F.when(~flat, F.corr(ga, gb)), 6).alias("gradient_corr"))


def seam_diffs(vertices: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Lattice vertices of several tiles whose heights differ by the tolerance or more."""
    v = vertices.groupBy("row_no", "col_no").agg(F.count("*").alias("tiles"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("tiles > 1")
    return v.withColumn("differs", F.col("hi") - F.col("lo") >= tolerance)
