"""Sight lines against extruded footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landfold.operators.polygons import point_in_polygon, ring_boxes
from landfold.plans.gridjoin import box_pairs

EPS = 1e-7


def occluded(pairs: DataFrame, edges: DataFrame, heights: DataFrame) -> DataFrame:
    """Pairs (pair_id, c camera, m marker, own_id) whose open segment passes strictly inside another footprint's volume.

    The segment is cut where it crosses the rings inside the footprint's box and height slab; it is hidden
    when the middle of some piece is strictly inside. Tangents and courtyards do not hide.
    """
    a = pairs.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("cx", "cy", "cz", "mx", "my", "mz"))).withColumns(
        {"ax0": F.least("cx", "mx"), "az0": F.least("cz", "mz"), "ax1": F.greatest("cx", "mx"), "az1": F.greatest("cz", "mz")})
    boxes = ring_boxes(edges, keys=("poly_id",)).join(heights.where("max_y > min_y").select("poly_id", "min_y", "max_y"), "poly_id")
    c = box_pairs(a, boxes, base=64.0).where("not (poly_id <=> own_id)")
    t0, t1, flat = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for o, mk, lo, hi in (("cx", "mx", "bx0", "bx1"), ("cy", "my", "min_y", "max_y"), ("cz", "mz", "bz0", "bz1")):
        d = F.col(mk) - F.col(o)
        still = F.abs(d) <= EPS
        safe = F.when(~still, d)
        p, q = (F.col(lo) - F.col(o)) / safe, (F.col(hi) - F.col(o)) / safe
        t0.append(F.when(still, 0.0).otherwise(F.least(p, q)))
        t1.append(F.when(still, 1.0).otherwise(F.greatest(p, q)))
        flat = flat | (still & ((F.col(o) <= F.col(lo) + EPS) | (F.col(o) >= F.col(hi) - EPS)))
    c = c.where(~flat).withColumns({"t0": F.greatest(*t0), "t1": F.least(*t1)}).where(F.col("t1") - F.col("t0") > EPS)
    c = c.select("pair_id", "poly_id", "cx", "cz", (F.col("mx") - F.col("cx")).alias("dx"), (F.col("mz") - F.col("cz")).alias("dz"), "t0", "t1")
    e = c.join(edges.select("poly_id", "x1", "z1", "x2", "z2"), "poly_id")
    ex, ez = F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")
    qx, qz = F.col("x1") - F.col("cx"), F.col("z1") - F.col("cz")
    den = F.col("dx") * ez - F.col("dz") * ex
    safe = F.when(F.abs(den) > EPS, den)
    length = F.nullif(F.col("dx") * F.col("dx") + F.col("dz") * F.col("dz"), F.lit(0.0))
    along = lambda x, z: ((F.col(x) - F.col("cx")) * F.col("dx") + (F.col(z) - F.col("cz")) * F.col("dz")) / length
    u = (qx * F.col("dz") - qz * F.col("dx")) / safe
    crossing = F.when(u.between(-EPS, 1 + EPS), (qx * ez - qz * ex) / safe)
    # A collinear edge cuts at both its ends.
    line = safe.isNull() & (F.abs(qx * F.col("dz") - qz * F.col("dx")) <= EPS)
    cuts = F.array_compact(F.array(crossing, F.when(line, along("x1", "z1")), F.when(line, along("x2", "z2"))))
    keep = ["pair_id", "poly_id", "cx", "cz", "dx", "dz"]
    inner = e.select(*keep, "t0", "t1", F.explode(cuts).alias("t")).where("t > t0 and t < t1").select(*keep, "t")
    ends = c.select(*keep, F.explode(F.array("t0", "t1")).alias("t"))
    # A window over one segment and one footprint: as many rows as that outline has edges.
    w = Window.partitionBy("pair_id", "poly_id").orderBy("t")
    mids = ends.unionByName(inner).withColumn("prev", F.lag("t").over(w)).where(F.col("t") - F.col("prev") > EPS)
    at = (F.col("t") + F.col("prev")) / 2
    # Upright segments have one middle; the test point is the same.
    probe = mids.select(F.struct("pair_id", "poly_id", "t").alias("pt_id"), (F.col("cx") + F.col("dx") * at).alias("x"), (F.col("cz") + F.col("dz") * at).alias("z"))
    inside = point_in_polygon(probe, edges, "exclude").where("pt_id.poly_id = poly_id")
    hidden = inside.select(F.col("pt_id.pair_id").alias("pair_id")).distinct()
    return pairs.join(hidden, "pair_id", "left_semi")


def label_visibility(pairs: DataFrame, edges: DataFrame, heights: DataFrame) -> DataFrame:
    hidden = occluded(pairs, edges, heights).select("pair_id").withColumn("hidden", F.lit(True))
    return pairs.join(hidden, "pair_id", "left").select("pair_id", F.col("hidden").isNull().alias("visible"))
