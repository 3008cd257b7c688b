"""Polygons as edge rows: (poly_id, part, ring, seq, x1, z1, x2, z2); ring 0 is the outline.

Rings are closed: the last edge returns to the first vertex. Nothing here
gathers a polygon into one row, so one polygon may hold any share of the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import (
    crosses_ray, seg_dist_sq, seg_intersects,
)
from landfold.plans.gridjoin import box_pairs, points_in_boxes, spread

SLAB = 16.0
STRICT_EPS = 1e-7
BAND = 1e-4
EDGE = ["x1", "z1", "x2", "z2"]


def ring_boxes(edges: DataFrame, pad: float = 0.0, keys=("poly_id", "part"), names=("bx0", "bz0", "bx1", "bz1")) -> DataFrame:
    """Box of each polygon part (every vertex starts one edge), widened by pad."""
    return edges.where("ring = 0").groupBy(*keys).agg(
        (F.min("x1") - pad).alias(names[0]), (F.min("z1") - pad).alias(names[1]),
        (F.max("x1") + pad).alias(names[2]), (F.max("z1") + pad).alias(names[3]),
    )


def _slab(z: Column, height: float) -> Column:
    return F.floor(z / height).cast("bigint")


def slab_edges(edges: DataFrame, pad: float, height: float = SLAB) -> DataFrame:
    """Each edge once per horizontal slab it touches; a point meets only its own slab."""
    lo = _slab(F.least("z1", "z2") - pad, height)
    hi = _slab(F.greatest("z1", "z2") + pad, height)
    return edges.withColumn("slab", F.explode(F.sequence(lo, hi)))


def _on_edge_strict(px: Column, pz: Column) -> Column:
    x1, z1, x2, z2 = map(F.col, EDGE)
    dx, dz = x2 - x1, z2 - z1
    side = (px - x1) * dz - (pz - z1) * dx
    return (
        (F.abs(side) <= F.lit(STRICT_EPS) * F.greatest(F.lit(1.0), F.abs(dx) + F.abs(dz)))
        & px.between(F.least(x1, x2) - STRICT_EPS, F.greatest(x1, x2) + STRICT_EPS)
        & pz.between(F.least(z1, z2) - STRICT_EPS, F.greatest(z1, z2) + STRICT_EPS)
    )


def ring_facts(points: DataFrame, edges: DataFrame, pad: float = BAND, pt: str = "pt_id", attributes: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """Per point, part and ring near it: crossing parity, strict boundary hit, squared distance.

    keep, over the points' columns and the attributes (one row per poly_id), drops pairs before any edge is met.
    """
    boxes = ring_boxes(edges, pad)
    if keep is None:
        cand = points_in_boxes(points.select(pt, "x", "z"), boxes)
    else:
        cand = points_in_boxes(points, boxes.join(attributes, "poly_id")).where(keep)
    cand = cand.select(pt, "x", "z", "poly_id", "part").withColumn("slab", _slab(F.col("z"), SLAB))
    pairs = cand.join(spread(slab_edges(edges, pad)), ["poly_id", "part", "slab"])
    px, pz = F.col("x"), F.col("z")
    return pairs.groupBy(pt, "poly_id", "part", "ring").agg(
        (F.sum(crosses_ray(px, pz, *EDGE).cast("int")) % 2 == 1).alias("odd"),
        F.max(_on_edge_strict(px, pz)).alias("touch"),
        F.min(seg_dist_sq(px, pz, *EDGE)).alias("d2"),
    )


def domain_hits(points: DataFrame, edges: DataFrame, domains: DataFrame, keep: Column, most_tolerance: float = 0.0, pt: str = "pt_id") -> DataFrame:
    """(pt, columns of domains) for each point inside a domain's outline or within its tolerance of it, and in no hole.

    domains: one row per poly_id; a column tolerance, if there is one, is at most most_tolerance, NULL for none. keep is
    tested where boxes meet points, so that only pairs that may count go on to the edges.
    """
    attributes = domains.withColumn("tolerance", F.col("tolerance") if "tolerance" in domains.columns else F.lit(None).cast("double"))
    near, outer = F.col("d2") <= BAND * BAND, F.col("ring") == 0
    parts = ring_facts(points, edges, max(most_tolerance, BAND), pt, attributes, keep).groupBy(pt, "poly_id", "part").agg(
        F.max(outer & (F.col("odd") | near)).alias("hit"), F.min(F.when(outer, F.col("d2"))).alias("off"),
        F.max(~outer & (F.col("odd") | near)).alias("cut"),
    )
    found = parts.where("not cut").join(attributes, "poly_id")
    return found.where(F.col("hit") | (F.col("off") <= F.col("tolerance") * F.col("tolerance"))).select(pt, *domains.columns)


def point_in_polygon(points: DataFrame, edges: DataFrame, boundary: str = "include_outer", pt: str = "pt_id") -> DataFrame:
    """(point, polygon) pairs with the point inside.

    exclude: no boundary counts, hole boundaries are outside too.
    include_outer: the outline belongs, a hole's boundary does not.
    include_all: the outline and hole boundaries belong.
    Boundaries are 1e-4 wide, except in exclude, where they are a 1e-7 tangent test.
    """
    near = F.col("d2") <= BAND * BAND
    outer, hole = F.col("ring") == 0, F.col("ring") > 0
    rules = {
        "exclude": (F.col("odd") & ~F.col("touch"), F.col("odd") | F.col("touch")),
        "include_outer": (F.col("odd") | near, F.col("odd") | near),
        "include_all": (F.col("odd") | near, F.col("odd") & ~near),
    }
    in_outer, in_hole = rules[boundary]
    parts = ring_facts(points, edges, pt=pt).groupBy(pt, "poly_id", "part").agg(
        F.max(outer & in_outer).alias("hit"), F.max(hole & in_hole).alias("cut")
    )
    return parts.where("hit and not cut").select(pt, "poly_id").distinct()


def point_in_polygon_tolerant(points: DataFrame, edges: DataFrame, tolerance: float = 0.15, pt: str = "pt_id") -> DataFrame:
    """Pairs inside, or outside the outline by at most the tolerance and in no hole."""
    near = F.col("d2") <= BAND * BAND
    outer, hole = F.col("ring") == 0, F.col("ring") > 0
    parts = ring_facts(points, edges, pad=max(tolerance, BAND), pt=pt).groupBy(pt, "poly_id", "part").agg(
        F.max(outer & (F.col("odd") | near)).alias("hit"),
        F.max(outer & (F.col("d2") <= tolerance * tolerance)).alias("close"),
        F.max(hole & (F.col("odd") | near)).alias("cut"),
    )
    return parts.where("(hit or close) and not cut").groupBy(pt, "poly_id").agg(F.max("hit").alias("inside"))


def signed_ring_area(edges: DataFrame, keys=("poly_id", "part", "ring")) -> DataFrame:
    return edges.groupBy(*keys).agg((F.sum(F.col("x1") * F.col("z2") - F.col("x2") * F.col("z1")) / 2).alias("signed_area"))


def poly_area(edges: DataFrame) -> DataFrame:
    """Net area: outlines less holes, whatever the winding."""
    sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    return signed_ring_area(edges).groupBy("poly_id").agg(
        F.sum(sign * F.abs("signed_area")).alias("net_area"),
        F.sum(F.when(F.col("ring") == 0, F.abs("signed_area"))).alias("gross_area"),
    )


def poly_centroid(edges: DataFrame) -> DataFrame:
    """Area-weighted centroid with holes; moments are taken about a corner of the polygon."""
    base = edges.where("ring = 0").groupBy("poly_id").agg(F.min("x1").alias("ox"), F.min("z1").alias("oz"))
    e = edges.join(base, "poly_id")
    x1, z1 = F.col("x1") - F.col("ox"), F.col("z1") - F.col("oz")
    x2, z2 = F.col("x2") - F.col("ox"), F.col("z2") - F.col("oz")
    w = x1 * z2 - x2 * z1
    rings = e.groupBy("poly_id", "part", "ring", "ox", "oz").agg(
        F.sum(w).alias("a2"), F.sum((x1 + x2) * w).alias("mx"), F.sum((z1 + z2) * w).alias("mz")
    )
    sign = F.signum("a2") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    sums = rings.groupBy("poly_id", "ox", "oz").agg(
        F.sum(sign * F.col("a2")).alias("a2"), F.sum(sign * F.col("mx")).alias("mx"), F.sum(sign * F.col("mz")).alias("mz")
    )
    whole = F.nullif(F.col("a2") * 3, F.lit(0.0))
    return sums.select("poly_id", (F.col("ox") + F.col("mx") / whole).alias("cx"), (F.col("oz") + F.col("mz") / whole).alias("cz"))


def label_point(edges: DataFrame, nodes: int = 17) -> DataFrame:
    """A point inside each polygon: its centroid, else the nearest interior node of a grid on its box."""
    centre = poly_centroid(edges)
    asked = centre.select(F.col("poly_id").alias("pt_id"), F.col("cx").alias("x"), F.col("cz").alias("z"))
    good = point_in_polygon(asked, edges, "exclude").where("pt_id = poly_id").select("poly_id")
    held = centre.join(good, "poly_id").select("poly_id", F.col("cx").alias("x"), F.col("cz").alias("z"), F.lit("centroid").alias("method"))
    boxes = ring_boxes(edges, keys=("poly_id",))
    loose = centre.join(good, "poly_id", "left_anti").join(boxes, "poly_id")
    step = F.lit(float(nodes - 1))
    grid = (
        loose.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
        .select(
            F.struct("poly_id", "i", "j").alias("pt_id"), "cx", "cz",
            (F.col("bx0") + (F.col("bx1") - F.col("bx0")) * F.col("i") / step).alias("x"),
            (F.col("bz0") + (F.col("bz1") - F.col("bz0")) * F.col("j") / step).alias("z"),
        )
    )
    inside = point_in_polygon(grid, edges, "exclude").where("pt_id.poly_id = poly_id").drop("poly_id")
    gap = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("z") - F.col("cz")) * (F.col("z") - F.col("cz"))
    best = (
        grid.join(inside, "pt_id")
        .groupBy(F.col("pt_id.poly_id").alias("poly_id"))
        .agg(F.min_by(F.struct("x", "z"), F.struct(gap, F.col("pt_id.i"), F.col("pt_id.j"))).alias("p"))
        .select("poly_id", "p.x", "p.z", F.lit("grid").alias("method"))
    )
    return held.unionByName(best)


def _renamed(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.select(
        F.col("poly_id").alias(f"{prefix}_id"), F.col("part").alias(f"{prefix}_part"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in EDGE],
    )


def _edge_pairs(a: DataFrame, b: DataFrame, distance: float) -> DataFrame:
    """Edges of two polygon sets whose boxes come within the distance of each other."""
    def boxed(edges, prefix, names, pad):
        e = _renamed(edges, prefix)
        x1, z1, x2, z2 = (F.col(f"{prefix}_{c}") for c in EDGE)
        return e.withColumns({
            names[0]: F.least(x1, x2) - pad, names[1]: F.least(z1, z2) - pad,
            names[2]: F.greatest(x1, x2) + pad, names[3]: F.greatest(z1, z2) + pad,
        })

    return box_pairs(
        boxed(a, "a", ("ax0", "az0", "ax1", "az1"), distance), boxed(b, "b", ("bx0", "bz0", "bx1", "bz1"), 0.0),
        base=max(32.0, 2 * distance),
    )


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs where one polygon holds the first outline vertex of the other (and not in a hole).

    Once no edges meet, one vertex settles whether a polygon lies in the other.
    """
    def starts(edges):
        first = edges.where("ring = 0").groupBy("poly_id", "part").agg(F.min_by(F.struct("x1", "z1"), "seq").alias("v"))
        return first.select(F.struct("poly_id", "part").alias("pt_id"), F.col("v.x1").alias("x"), F.col("v.z1").alias("z"))

    a_in_b = point_in_polygon(starts(a), b).select(F.col("pt_id.poly_id").alias("a_id"), F.col("poly_id").alias("b_id"))
    b_in_a = point_in_polygon(starts(b), a).select(F.col("poly_id").alias("a_id"), F.col("pt_id.poly_id").alias("b_id"))
    return a_in_b.unionByName(b_in_a)


def poly_intersects(a: DataFrame, b: DataFrame, keep: Column | str = "true") -> DataFrame:
    """(a_id, b_id) of polygons that meet: edges cross or touch, or one holds the other.

    keep is a predicate on a_id and b_id, such as "a_id < b_id" for a self join.
    """
    keep = F.expr(keep) if isinstance(keep, str) else keep
    met = _edge_pairs(a, b, 0.0).where(keep).where(
        seg_intersects([f"a_{c}" for c in EDGE], [f"b_{c}" for c in EDGE])
    ).select("a_id", "b_id")
    return met.unionByName(contained(a, b).where(keep)).distinct()


def within_distance(a: DataFrame, b: DataFrame, distance: float, keep: Column | str = "true") -> DataFrame:
    """(a_id, b_id) of polygons no farther apart than the distance; no buffer is built."""
    keep = F.expr(keep) if isinstance(keep, str) else keep
    p, q = [f"a_{c}" for c in EDGE], [f"b_{c}" for c in EDGE]
    # Distances are folded by pair and tested after: an aggregate computes their common terms once, the condition of a join each time anew.
    ends = F.least(seg_dist_sq(p[0], p[1], *q), seg_dist_sq(p[2], p[3], *q), seg_dist_sq(q[0], q[1], *p), seg_dist_sq(q[2], q[3], *p))
    near = _edge_pairs(a, b, distance).where(keep).groupBy("a_id", "b_id").agg(F.min(ends).alias("d2"), F.max(seg_intersects(p, q)).alias("meet"))
    near = near.where(F.col("meet") | (F.col("d2") <= distance * distance)).select("a_id", "b_id")
    return near.unionByName(contained(a, b).where(keep)).distinct()


def geometry_violations(edges: DataFrame) -> DataFrame:
    """Rule and polygon for rings that are open, short, flat or not finite.

    A closed ring leaves every vertex as often as it enters it: starts count +1 and ends -1 at their exact coordinates,
    so rounding plays no part. A ring is flat if its area is within rounding of the sum of the products it is made of.
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    ring = ["poly_id", "part", "ring"]
    x1, z1, x2, z2 = (F.col(c) for c in EDGE)
    ends = F.inline(F.array(F.struct(x1.alias("x"), z1.alias("z"), F.lit(1).alias("way")), F.struct(x2.alias("x"), z2.alias("z"), F.lit(-1).alias("way"))))
    balance = edges.select(*ring, ends).groupBy(*ring, "x", "z").agg(F.sum("way").alias("way"))
    gaps = balance.groupBy(*ring).agg(F.max(F.col("way") != 0).alias("open"))
    rings = edges.groupBy(*ring).agg(
        F.count("*").alias("n"), F.max(bad("x1") | bad("z1") | bad("x2") | bad("z2")).alias("not_finite"),
        F.sum(x1 * z2 - x2 * z1).alias("a2"), F.sum(F.abs(x1 * z2) + F.abs(x2 * z1)).alias("size"),
    ).join(gaps, ring)
    rules = F.array(
        F.when(F.col("not_finite"), F.lit("not-finite")),
        F.when(F.col("n") < 3, F.lit("too-few-vertices")),
        F.when(~F.col("not_finite") & F.col("open"), F.lit("open-ring")),
        F.when(~F.col("not_finite") & (F.abs("a2") <= 1e-12 * F.col("size")), F.lit("zero-area")),
    )
    return rings.select(*ring, F.explode(F.array_compact(rules)).alias("rule"))


def box_violations(boxes: DataFrame, limit: float = 0.0) -> DataFrame:
    """(id, rule) of bounds that are not finite or reversed, and of floors whose declared height is not that of all their vertices.

    boxes: id, min_x..max_z, and low_y and high_y of the vertices that a planar part must share up to the limit, NULL if
    the part need not be planar.
    """
    axes = "xyz"
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    wild, turned = F.lit(False), F.lit(False)
    for a in axes:
        wild = wild | bad(f"min_{a}") | bad(f"max_{a}")
        turned = turned | F.coalesce(F.col(f"min_{a}") > F.col(f"max_{a}"), F.lit(False))
    rules = F.array(F.when(wild, F.lit("bounds-not-finite")), F.when(~wild & turned, F.lit("bounds-reversed")),
                    F.when(F.coalesce(F.col("high_y") - F.col("low_y") > limit, F.lit(False)), F.lit("not-planar")))
    return boxes.select("id", F.explode(F.array_compact(rules)).alias("rule"))
