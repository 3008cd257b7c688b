"""Attribution of points to domains, ranges, lines and surfaces, with ambiguity as a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import seg_dist_sq
from landfold.operators.polygons import (
    EDGE, domain_hits, point_in_polygon, poly_area,
)
from landfold.plans.gridjoin import points_in_boxes


def _owners(points: DataFrame, hits: DataFrame, single: str, many: str, none: str, pt: str = "pt_id") -> DataFrame:
    """One row per point, by one exchange. Two owners differ iff the least and the greatest do."""
    rows = hits.select(pt, "entity_id").unionByName(points.select(pt, F.lit(None).cast("string").alias("entity_id")))
    owned = rows.groupBy(pt).agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    return owned.select(
        pt,
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("entity_id"),
        F.when(F.col("lo").isNull(), none).when(F.col("lo") == F.col("hi"), single).otherwise(many).alias("method"),
    )


def settled_envelopes(domains: DataFrame) -> DataFrame:
    """The domains with shared_with cleared where two entities name each other and the other's domain comes first."""
    first = domains.groupBy("entity_id", "shared_with").agg(F.min("poly_id").alias("poly_id")).where("shared_with is not null and shared_with <> entity_id")
    other = first.select(F.col("entity_id").alias("shared_with"), F.col("shared_with").alias("entity_id"), F.col("poly_id").alias("other"))
    lost = first.join(other, ["entity_id", "shared_with"]).where("other < poly_id").select("entity_id", "shared_with", F.lit(True).alias("lost"))
    out = domains.join(lost, ["entity_id", "shared_with"], "left")
    return out.select(*[F.when(F.col("lost"), None).otherwise(F.col(c)).alias(c) if c == "shared_with" else F.col(c) for c in domains.columns])


def without_shared(hits: DataFrame, keys: list[str], carry: list | None = None) -> DataFrame:
    """(keys, entity_id, carried minima) of the candidates that no other candidate of the point names as its shared envelope.

    All names count at once; two that name each other are settled by settled_envelopes(). Hits and names fold together
    by (keys, entity), so no point's candidates are gathered.
    """
    carry = carry or []
    named = hits.where(F.col("shared_with").isNotNull() & (F.col("shared_with") != F.col("entity_id")))
    rows = hits.select(*keys, "entity_id", F.lit(False).alias("gone"), *carry).unionByName(
        named.select(*keys, F.col("shared_with").alias("entity_id"), F.lit(True).alias("gone")), allowMissingColumns=True)
    kept = rows.groupBy(*keys, "entity_id").agg(F.max("gone").alias("gone"), *[F.min(c).alias(c) for c in carry])
    return kept.where("not gone").drop("gone")


def attribute_points(points: DataFrame, edges: DataFrame, domains: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Owner of each point: one domain, ambiguous, or unassigned.

    A domain counts only for points no lower than half a metre under its floor. Domains may have columns tolerance (how
    far outside the outline still counts; the argument sets one for all) and shared_with: an entity whose envelope the
    domain's shares, which is no candidate where the domain's entity is one.
    """
    domains = domains.select("poly_id", "entity_id", "min_y", *[c for c in ("tolerance", "shared_with") if c in domains.columns])
    if tolerance is not None:
        domains = domains.withColumn("tolerance", F.lit(float(tolerance)))
    most = tolerance if tolerance is not None else (domains.agg(F.max("tolerance")).first()[0] or 0.0) if "tolerance" in domains.columns else 0.0
    shared = "shared_with" in domains.columns
    hits = domain_hits(points.select("pt_id", "x", "z", "y"), edges, settled_envelopes(domains) if shared else domains, F.col("y") >= F.col("min_y") - 0.5, most)
    return _owners(points, without_shared(hits, ["pt_id"]) if shared else hits, "source-footprint-and-height", "ambiguous-source-footprints", "unassigned")


def attribute_ranges(points: DataFrame, edges: DataFrame, ranges: DataFrame) -> DataFrame:
    """Owner among height-banded ranges. A point that names a source object is bound to ranges listing it."""
    keep = F.col("y").between(F.col("min_y") - 0.5, F.col("max_y") + 0.5)
    keep &= F.col("source_object_id").isNull() | F.array_contains("source_object_ids", F.col("source_object_id"))
    hits = domain_hits(points.select("pt_id", "x", "z", "y", "source_object_id"), edges, ranges.select("poly_id", "entity_id", "min_y", "max_y", "source_object_ids"), keep)
    return _owners(points, hits, "source-range-footprint-and-height", "ambiguous-source-ranges", "unassigned")


def nearest_line(points: DataFrame, segments: DataFrame, limit: float = 4.0) -> DataFrame:
    """Nearest ground-visible line strictly closer than the limit; ties go to the smaller id."""
    shown = segments.where("show_ground").withColumns({
        "bx0": F.least("x1", "x2") - limit, "bz0": F.least("z1", "z2") - limit,
        "bx1": F.greatest("x1", "x2") + limit, "bz1": F.greatest("z1", "z2") + limit,
    })
    pairs = points_in_boxes(points.select("pt_id", "x", "z"), shown, base=16.0)
    near = pairs.withColumn("d2", seg_dist_sq("x", "z", *EDGE)).where(F.col("d2") < limit * limit)
    return near.groupBy("pt_id").agg(
        F.min_by("entity_id", F.struct("d2", "entity_id")).alias("entity_id"),
        F.sqrt(F.min("d2")).alias("distance"),
    )


def nearest_polygon(points: DataFrame, edges: DataFrame, cap: float = 6.0) -> DataFrame:
    """Nearest polygon no farther than the cap; inside counts as distance 0."""
    outer = edges.where("ring = 0").withColumns({
        "bx0": F.least("x1", "x2") - cap, "bz0": F.least("z1", "z2") - cap,
        "bx1": F.greatest("x1", "x2") + cap, "bz1": F.greatest("z1", "z2") + cap,
    })
    rim = (
        points_in_boxes(points.select("pt_id", "x", "z"), outer.select("poly_id", *EDGE, "bx0", "bz0", "bx1", "bz1"), base=16.0)
        .withColumn("d2", seg_dist_sq("x", "z", *EDGE)).where(F.col("d2") <= cap * cap)
        .select("pt_id", "poly_id", "d2")
    )
    inside = point_in_polygon(points, edges.where("ring = 0")).withColumn("d2", F.lit(0.0))
    return rim.unionByName(inside).groupBy("pt_id").agg(
        F.min_by("poly_id", F.struct("d2", "poly_id")).alias("poly_id"), F.sqrt(F.min("d2")).alias("distance")
    )


def smallest_containing(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Most specific of the nested polygons around each point: the smallest net area."""
    hits = point_in_polygon(points, edges).join(poly_area(edges), "poly_id")
    return hits.groupBy("pt_id").agg(
        F.min_by("poly_id", F.struct("net_area", "poly_id")).alias("poly_id"), F.min("net_area").alias("net_area")
    )


def label_identity(labels: DataFrame, assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """For each label: does it lie in every polygon assigned to it?

    labels: pt_id, x, z; assigned: pt_id, poly_id.
    """
    found = point_in_polygon(labels, edges).withColumn("found", F.lit(True))
    return assigned.join(found, ["pt_id", "poly_id"], "left").groupBy("pt_id").agg(
        F.count("*").alias("assigned"), F.count("found").alias("holding"),
        F.bool_and(F.col("found").isNotNull()).alias("matched"),
    )
