"""Source bodies compared with each other: support above a level, the interface of two bodies, clearance below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.functions.geometry import barycentric_xz
from landfold.operators.polygons import point_in_polygon
from landfold.operators.raster import triangles_to_cells
from landfold.plans.boxtree import box_gap, nearest_boxes
from landfold.plans.components import connected
from landfold.plans.gridjoin import box_pairs, points_in_boxes, spread
from landfold.plans.ordered import quantiles
from landfold.session import cut_lineage

FLAT_AREA = 1e-9
#: side of the cells in which boxes meet, and the most of them across that a box is met with all it covers
CELL, WIDE = 32.0, 8


def _vertex(i: int) -> Column:
    return F.struct(*[F.col(f"{a}{i}").alias(a) for a in "xyz"])


def _crossing(i: int, j: int, level: Column) -> Column:
    t = (level - F.col(f"y{i}")) / F.nullif(F.col(f"y{j}") - F.col(f"y{i}"), F.lit(0.0))
    return F.struct(*[(F.col(f"{a}{i}") + (F.col(f"{a}{j}") - F.col(f"{a}{i}")) * t).alias(a) for a in "xyz"])


def clip_above(tri: DataFrame, level: str) -> DataFrame:
    """The part of each face on or above its level: `polygon`, an array of 3 or 4 vertices in the face's order, and its area in plan.

    Faces wholly below and parts of no area in plan are left out. Other columns stay.
    """
    at, inside = F.col(level), {i: F.col(f"y{i}") >= F.col(level) for i in (1, 2, 3)}
    walk = []
    for i, j in ((1, 2), (2, 3), (3, 1)):
        walk += [F.when(inside[i], _vertex(i)), F.when(inside[i] != inside[j], _crossing(i, j, at))]
    out = tri.where(inside[1] | inside[2] | inside[3]).select("*", F.inline(F.array(F.struct(F.array_compact(F.array(*walk)).alias("polygon")))))
    p = F.col("polygon")
    ring = F.transform(p, lambda v, i: (v["x"] * F.get(p, (i + 1) % F.size(p))["z"] - F.get(p, (i + 1) % F.size(p))["x"] * v["z"]))
    area = F.abs(F.aggregate(ring, F.lit(0.0), lambda s, x: s + x)) / 2
    return out.where(F.size("polygon") >= 3).select("*", F.inline(F.array(F.struct(area.alias("plan_area"))))).where(F.col("plan_area") > FLAT_AREA)


def fan(clipped: DataFrame) -> DataFrame:
    """Each clipped polygon as one or two faces x1..z3 in place of the ones it came from."""
    p = F.col("polygon")
    keep = [c for c in clipped.columns if c not in {"polygon", *(f"{a}{i}" for a in "xyz" for i in (1, 2, 3))}]
    faces = F.array_compact(F.array(*[F.when(F.size(p) > k, F.struct(F.get(p, 0).alias("a"), F.get(p, k - 1).alias("b"), F.get(p, k).alias("c"))) for k in (2, 3)]))
    return clipped.select(*keep, F.inline(faces)).select(*keep, *[F.col(f"{v}.{a}").alias(f"{a}{i}") for i, v in enumerate("abc", 1) for a in "xyz"])


def slice_support(tri: DataFrame, body: str, step: float, slices: tuple[float, ...] = (0.25, 0.5, 0.75), large: float = 10.0) -> DataFrame:
    """What carries each body above given shares of its height, seen from above.

    (body, slice, cut_y, faces, clipped_area, cells, area, parts, large_parts, largest): faces with a part above the cut,
    the sum of their plan areas, and the union of these on cell centres: cells, area, parts that share cell edges, how
    many are larger than `large` square metres, and the largest. A slice that nothing reaches in plan has zeros.
    """
    span = tri.groupBy(body).agg(*[f(g(*[F.col(f"y{i}") for i in (1, 2, 3)])).alias(n) for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    levels = cut_lineage(span.select(F.col(body).alias("body"), F.explode(F.array(*[F.lit(float(s)) for s in slices])).alias("slice"), "lo", "hi").select(
        "body", "slice", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("slice")).alias("cut_y")))
    faces = tri.select(F.col(body).alias("body"), "tile_id", "tri_idx", *[f"{a}{i}" for a in "xyz" for i in (1, 2, 3)]).join(levels, "body")
    clipped = cut_lineage(clip_above(faces, "cut_y").select("body", "slice", "tile_id", "tri_idx", "plan_area", "polygon"))
    counted = clipped.groupBy("body", "slice").agg(F.count("*").alias("faces"), F.sum("plan_area").alias("clipped_area"))
    pieces = fan(clipped.withColumn("tile_id", F.struct("body", "slice")))
    cells = cut_lineage(triangles_to_cells(pieces, step).select("tile_id.*", "row_no", "col_no").distinct())
    # Cells side by side in a row are one run, named by its first cell; only runs of neighbouring rows have to be connected.
    along = Window.partitionBy("body", "slice", "row_no").orderBy("col_no")
    cells = cells.withColumn("gap", F.col("col_no") - F.row_number().over(along))
    runs = cut_lineage(cells.groupBy("body", "slice", "row_no", "gap").agg(F.min("col_no").alias("col_no"), F.count("*").alias("n")).drop("gap"))
    node = F.struct("body", "slice", "row_no", "col_no")
    spans = runs.select("body", "slice", "row_no", node.alias("u"), F.explode(F.sequence("col_no", F.col("col_no") + F.col("n") - 1)).alias("at"))
    beside = spans.select("body", "slice", (F.col("row_no") - 1).alias("row_no"), F.col("u").alias("v"), "at")
    edges = spans.join(spread(beside), ["body", "slice", "row_no", "at"]).select("u", "v")
    comp = connected(runs.select(node.alias("id")), edges).join(runs.select(node.alias("id"), "n"), "id")
    size = comp.groupBy("component").agg((F.sum("n") * F.lit(step * step)).alias("size"))
    parts = size.groupBy(F.col("component.body").alias("body"), F.col("component.slice").alias("slice")).agg(
        F.sum("size").alias("area"), F.count("*").alias("parts"), F.count(F.when(F.col("size") > large, 1)).alias("large_parts"), F.max("size").alias("largest"))
    out = levels.join(counted, ["body", "slice"], "left").join(parts, ["body", "slice"], "left").withColumn("cells", F.rint(F.col("area") / (step * step)).cast("bigint"))
    out = out.fillna(0.0, ["clipped_area", "area", "largest"]).fillna(0, ["faces", "cells", "parts", "large_parts"])
    return out.select("body", "slice", "cut_y", "faces", "clipped_area", "cells", "area", "parts", "large_parts", "largest")


def nearest_cells(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, row_no, col_no, d2): squared distance in cells from each point to the nearest cell of its key; none if the key has no cell.

    Rounds of doubling reach: what has a cell within the reach is settled by the nine blocks of that size around it, and
    only the rest goes on; so a point meets the cells of about the ring in which its nearest one lies. Rounds are the
    logarithm of the widest gap.
    """
    todo = cut_lineage(points.join(cells.select(key).distinct(), key, "left_semi").select(key, "row_no", "col_no").distinct())
    found, reach = None, 1
    while not todo.isEmpty():
        block = [F.floor(F.col(c) / reach) for c in ("row_no", "col_no")]
        near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        p = todo.select(key, "row_no", "col_no", near.alias("n"), *[b.alias(n) for b, n in zip(block, ("r", "c"))]).select(key, "row_no", "col_no", (F.col("r") + F.col("n.a")).alias("r"), (F.col("c") + F.col("n.b")).alias("c"))
        q = cells.select(key, F.col("row_no").alias("to_row"), F.col("col_no").alias("to_col"), *[b.alias(n) for b, n in zip(block, ("r", "c"))])
        dr, dc = F.col("row_no") - F.col("to_row"), F.col("col_no") - F.col("to_col")
        met = p.join(spread(q), [key, "r", "c"]).groupBy(key, "row_no", "col_no").agg(F.min(dr * dr + dc * dc).alias("d2"))
        done = cut_lineage(met.where(F.col("d2") <= reach * reach))
        found = done if found is None else found.unionByName(done)
        todo = cut_lineage(todo.join(spread(done.select(key, "row_no", "col_no")), [key, "row_no", "col_no"], "left_anti"), replaces=todo)
        reach *= 2
    return found if found is not None else todo.withColumn("d2", F.lit(None).cast("bigint"))


def interfaces(cells: DataFrame, pairs: DataFrame, pixel: float, edges: DataFrame, band: float = 1e-3) -> DataFrame:
    """How an upper body (b) stands on a lower one (a), from their top cells (body, row_no, col_no, y), for each pair (a, b).

    level_step: top of a less foot of b; shared_area, only_a, only_b: of their plans; min_step, max_step, mean_step: over
    shared cells; foot_cells: cells of b at its foot, give or take the band; contact_area: those that a's cells at that
    level hold too; distance_min, _median, _p95, _max: in plan, from the foot cells to the nearest such cell of a, NULL if
    there is none; outside_area: cells of a in no polygon of the edges.
    """
    area = lambda test: F.count(F.when(test, 1)) * F.lit(pixel * pixel)
    key = F.struct("a", "b")
    span = cells.groupBy("body").agg(F.min("y").alias("foot"), F.max("y").alias("top"))
    ends = pairs.join(span.select(F.col("body").alias("a"), "top"), "a").join(span.select(F.col("body").alias("b"), "foot"), "b")
    ends = cut_lineage(ends.select(key.alias("pair"), "a", "b", "foot", (F.col("top") - F.col("foot")).alias("level_step")))
    lower = ends.join(cells.withColumnRenamed("body", "a"), "a").select("pair", "foot", "row_no", "col_no", "y")
    upper = ends.join(cells.withColumnRenamed("body", "b"), "b").select("pair", "foot", "row_no", "col_no", "y")
    both = lower.select("pair", "row_no", "col_no", F.col("y").alias("ya"), F.lit(None).cast("double").alias("yb")).unionByName(
        upper.select("pair", "row_no", "col_no", F.lit(None).cast("double").alias("ya"), F.col("y").alias("yb"))).groupBy("pair", "row_no", "col_no").agg(F.max("ya").alias("ya"), F.max("yb").alias("yb"))
    step = F.col("ya") - F.col("yb")
    plan = both.groupBy("pair").agg(area(step.isNotNull()).alias("shared_area"), area(F.col("yb").isNull()).alias("only_a"), area(F.col("ya").isNull()).alias("only_b"),
                                    F.min(step).alias("min_step"), F.max(step).alias("max_step"), F.avg(step).alias("mean_step"))
    level = F.abs(F.col("y") - F.col("foot")) <= band
    foot, roof = (cut_lineage(x.where(level).select("pair", "row_no", "col_no")) for x in (upper, lower))
    far = cut_lineage(nearest_cells(foot, roof, "pair").select("pair", (F.sqrt(F.col("d2").cast("double")) * pixel).alias("distance")))
    names = ["distance_min", "distance_median", "distance_p95", "distance_max"]
    spread = quantiles(far, ["pair"], "distance", [0.0, 0.5, 0.95, 1.0], names)
    touch = foot.groupBy("pair").agg(F.count("*").alias("foot_cells"))
    contact = far.groupBy("pair").agg(area(F.col("distance") == 0).alias("contact_area"))
    centre = cells.select(F.struct("body", "row_no", "col_no").alias("pt_id"), ((F.col("col_no") + 0.5) * pixel).alias("x"), ((F.col("row_no") + 0.5) * pixel).alias("z"))
    held = point_in_polygon(centre, edges).select("pt_id", F.lit(True).alias("held")).distinct()
    outside = centre.join(held, "pt_id", "left").groupBy(F.col("pt_id.body").alias("a")).agg(area(F.col("held").isNull()).alias("outside_area"))
    out = ends.join(plan, "pair").join(touch, "pair", "left").join(contact, "pair", "left").join(spread, "pair", "left").join(outside, "a", "left")
    return out.fillna(0.0, ["contact_area", "outside_area"]).fillna(0, ["foot_cells"]).select(
        "a", "b", "level_step", "shared_area", "only_a", "only_b", "min_step", "max_step", "mean_step", "foot_cells", "contact_area", *names, "outside_area")


def surface_below(points: DataFrame, tri: DataFrame, lift: float = 0.01) -> DataFrame:
    """(pt_id, gap, tile_id, tri_idx): the nearest face straight below each point (pt_id, own, x, y, z), faces of its own component left out.

    A ray from just under the point meets the faces whose plan boxes hold it, on the grid; edge-on faces are not met.
    tri: component and the face's columns.
    """
    boxes = tri.select("component", "tile_id", "tri_idx", *[f"{a}{i}" for a in "xyz" for i in (1, 2, 3)], *[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"b{a}{k}") for a in "xz" for k, f in ((0, F.least), (1, F.greatest))])
    met = points_in_boxes(points.select("pt_id", "own", "x", F.col("y").alias("py"), "z"), boxes, base=16.0).where("component <> own")
    u, v, height = barycentric_xz(F.col("x"), F.col("z"))
    met = met.select("pt_id", "py", "tile_id", "tri_idx", F.inline(F.array(F.struct(u.alias("u"), v.alias("v"), height.alias("h")))))
    hit = met.where("u >= 0 and v >= 0 and u + v <= 1").withColumn("gap", F.col("py") - lift - F.col("h")).where("gap > 0")
    return hit.groupBy("pt_id").agg(F.min(F.struct("gap", "tile_id", "tri_idx")).alias("w")).select("pt_id", "w.*")


def clearance(tri: DataFrame, reach: float) -> DataFrame:
    """(component, separation, gap_below, samples, open_samples): how far each component hangs from all others.

    separation: least gap between its box and the box of a face of another, within the reach (a lower bound of the
    distance), NULL beyond; gap_below: least drop from the middle of a face of it to another component's face straight
    below; open_samples: faces with nothing below. tri: component and the face's columns.
    """
    faces = tri.select("component", "tile_id", "tri_idx", *[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.least), ("hi", F.greatest))])
    box = cut_lineage(faces.groupBy("component").agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]))
    a = box.select(F.col("component").alias("a"), *[F.col(f"{n}_{c}").alias(f"a{n}{c}") for n in ("lo", "hi") for c in "xyz"],
                   *[(F.col(f"{n}_{c}") + s * reach).alias(f"a{c}{k}") for c in "xz" for k, (n, s) in enumerate((("lo", -1), ("hi", 1)))])
    b = faces.select(F.col("component").alias("b"), *[F.col(f"{n}_{c}").alias(f"b{n}{c}") for n in ("lo", "hi") for c in "xyz"],
                     *[F.col(f"{n}_{c}").alias(f"b{c}{k}") for c in "xz" for k, n in enumerate(("lo", "hi"))])
    # A wide box may cover any share of all faces: those go down a tree of them, where most are never met.
    wide = F.greatest(F.col("ax1") - F.col("ax0"), F.col("az1") - F.col("az0")) > WIDE * CELL
    near = box_pairs(a.where(~wide), b, base=CELL).where("a <> b").select("a", F.inline(F.array(F.struct(box_gap().alias("d")))))
    near = near.where(F.col("d") <= reach).groupBy("a").agg(F.min("d").alias("d"))
    if not a.where(wide).isEmpty():
        near = near.unionByName(nearest_boxes(a.where(wide), b, reach, CELL))
    near = near.select(F.col("a").alias("component"), F.col("d").alias("separation"))
    middle = tri.select(F.struct("tile_id", "tri_idx").alias("pt_id"), F.col("component").alias("own"), *[((F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 3).alias(c) for c in "xyz"])
    below = middle.select("pt_id", "own").join(surface_below(middle, tri).select("pt_id", "gap"), "pt_id", "left")
    drop = below.groupBy(F.col("own").alias("component")).agg(F.min("gap").alias("gap_below"), F.count("*").alias("samples"), F.count(F.when(F.col("gap").isNull(), 1)).alias("open_samples"))
    return drop.join(near, "component", "left").select("component", "separation", "gap_below", "samples", "open_samples")
