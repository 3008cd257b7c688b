"""Triangle tables: (tile_id, tri_idx, x1..z3), tri_idx unique over all tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import corners, cross, dot, face_area, face_normal, normalise, quantise, sub
from landfold.plans.components import connected
from landfold.plans.gridjoin import box_pairs, held, spread
from landfold.plans.ordered import quantiles

VERTEX = ["qx", "qy", "qz"]


def face_vertices(tri: DataFrame, step: float, *keep: str) -> DataFrame:
    """One row per face corner with its lattice position."""
    c = F.array(*[F.struct(*[quantise(f"{a}{i}", step).alias(f"q{a}") for a in "xyz"]) for i in (1, 2, 3)])
    return tri.select("tile_id", "tri_idx", *keep, F.inline(c))


def components(tri: DataFrame, step: float = 1e-5, scope: list[str] | None = None) -> DataFrame:
    """(tri_idx, component) of faces joined through shared lattice vertices, within the scope columns if given."""
    keys = [*VERTEX, *(scope or [])]
    v = face_vertices(tri, step).select("tri_idx", *keys)
    hub = v.groupBy(*keys).agg(F.min("tri_idx").alias("hub"))
    edges = v.join(spread(hub), keys).select(F.col("tri_idx").alias("u"), F.col("hub").alias("v"))
    out = connected(tri.select(F.col("tri_idx").alias("id")), edges)
    return out.withColumnRenamed("id", "tri_idx")


def closure(tri: DataFrame, comp: DataFrame, seeds: DataFrame, step: float = 1e-5) -> DataFrame:
    """Whole components of the seed faces, and whether one shares a vertex with any face outside them."""
    hit = comp.join(seeds.select("tri_idx"), "tri_idx", "left_semi").select("component").distinct()
    faces = comp.join(hit, "component", "left_semi")
    v = face_vertices(tri, step).join(comp, "tri_idx")
    inside = v.join(hit, "component", "left_semi").select("component", *VERTEX).distinct()
    outside = v.join(hit, "component", "left_anti").select(*VERTEX)
    shared = inside.join(outside, VERTEX, "left_semi").select("component").distinct().withColumn("touches_retained", F.lit(True))
    size = faces.groupBy("component").agg(F.count("*").alias("faces"))
    return size.join(shared, "component", "left").withColumn("touches_retained", F.coalesce("touches_retained", F.lit(False)))


def component_stats(tri: DataFrame, comp: DataFrame, ground: DataFrame) -> DataFrame:
    """Faces, area, spans and the distribution of the centroid's gap to the ground. ground: tri_idx, ground."""
    t = spread(tri).join(comp, "tri_idx").withColumn("area", face_area())
    lo = {a: F.least(*[F.col(f"{a}{i}") for i in (1, 2, 3)]) for a in "xyz"}
    hi = {a: F.greatest(*[F.col(f"{a}{i}") for i in (1, 2, 3)]) for a in "xyz"}
    flat = t.groupBy("component").agg(
        F.count("*").alias("faces"), F.sum("area").alias("area"),
        *[F.min(lo[a]).alias(f"min_{a}") for a in "xyz"], *[F.max(hi[a]).alias(f"max_{a}") for a in "xyz"])
    gaps = t.join(ground, "tri_idx").select("component", ((F.col("y1") + F.col("y2") + F.col("y3")) / 3 - F.col("ground")).alias("gap"))
    return flat.join(quantiles(gaps, ["component"], "gap", [0.05, 0.5], ["gap_p05", "gap_median"]), "component", "left")


def floater_gate(stats: DataFrame) -> DataFrame:
    """Small, isolated-looking, elevated components (fixed thresholds)."""
    return stats.where(
        (F.col("faces") <= 120) & F.col("area").between(0.01, 50.0)
        & (F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z")) <= 8.0)
        & (F.col("max_y") - F.col("min_y") <= 8.0) & (F.col("gap_p05") > 2.0))


def isolated(candidates: DataFrame, comp: DataFrame, tri: DataFrame, step: float = 1e-5) -> DataFrame:
    """Candidate components (component, tile_id) none of whose vertices occur in another tile.

    Only candidate vertices are looked up; per vertex the least and greatest tile tell whether another tile has it.
    """
    v = face_vertices(tri, step)
    mine = v.join(comp.join(candidates.select("component"), "component", "left_semi"), "tri_idx").select("component", "tile_id", *VERTEX).distinct()
    tiles = v.join(mine.select(*VERTEX).distinct(), VERTEX, "left_semi").groupBy(*VERTEX).agg(F.min("tile_id").alias("lo"), F.max("tile_id").alias("hi"))
    shared = mine.join(tiles, VERTEX).where("lo <> tile_id or hi <> tile_id").select("component").distinct()
    return candidates.join(shared, "component", "left_anti")


def _edges(tri: DataFrame, *keep) -> DataFrame:
    pts = [F.struct(*[F.col(f"{a}{i}").alias(a) for a in "xyz"]) for i in (1, 2, 3)]
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ((pts[0], pts[1]), (pts[1], pts[2]), (pts[2], pts[0]))])
    return tri.select("tri_idx", *keep, F.inline(pairs))


def _flat_edge(df: DataFrame, *rest) -> DataFrame:
    return df.select(*[F.col(f"{p}.{a}").alias(f"{p}{a}") for p in "ab" for a in "xyz"], *rest)


def boundary_edges(tri: DataFrame) -> DataFrame:
    """Undirected edges used by one face only."""
    return _flat_edge(_edges(tri).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1"))


def crease_edges(tri: DataFrame, degrees: float = 35.0) -> DataFrame:
    """Edges of one face, or of two faces whose normals differ by more than the angle.

    Two unit normals have |n1 + n2|² = 2 + 2 cos, so sums replace a list of normals.
    """
    import math

    n = dict(zip(("nx", "ny", "nz"), normalise(face_normal())))
    e = _edges(tri, *[c.alias(k) for k, c in n.items()])
    s = e.groupBy("a", "b").agg(F.count("*").alias("faces"), *[F.sum(k).alias(k) for k in n])
    cos = (F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) / 2 - 1
    return _flat_edge(s.where((F.col("faces") == 1) | ((F.col("faces") == 2) & (cos < math.cos(math.radians(degrees)) - 1e-12))), "faces")


def dedup_segments(seg: DataFrame) -> DataFrame:
    """Distinct plan segments whatever their direction; zero-length ones dropped."""
    a, b = F.struct(F.col("x1").alias("x"), F.col("z1").alias("z")), F.struct(F.col("x2").alias("x"), F.col("z2").alias("z"))
    d = seg.where("x1 <> x2 or z1 <> z2").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return d.select(*[F.col(f"{p}.{c}").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in "xz"])


def witnesses(tri: DataFrame, keys: list[str]) -> DataFrame:
    """Largest face per key; ties go to the smaller index."""
    t = tri.withColumn("area", face_area())
    return t.groupBy(*keys).agg(F.min_by(F.struct("tri_idx", "area"), F.struct(-F.col("area"), "tri_idx")).alias("w")).select(*keys, "w.*")


def apply_corrections(tri: DataFrame, removed: DataFrame) -> DataFrame:
    """Faces left after dropping the listed (tile, face) pairs."""
    return tri.join(removed.select("tile_id", "tri_idx"), ["tile_id", "tri_idx"], "left_anti")


def correction_proof(tri: DataFrame, removed: DataFrame, retained: DataFrame) -> DataFrame:
    """Counts per tile: removals asked for, faces gone, faces altered (which must be 0)."""
    asked = removed.groupBy("tile_id").agg(F.count("*").alias("asked"))
    before = tri.groupBy("tile_id").agg(F.count("*").alias("before"))
    after = retained.groupBy("tile_id").agg(F.count("*").alias("after"))
    altered = retained.exceptAll(tri.select(*retained.columns)).groupBy("tile_id").agg(F.count("*").alias("altered"))
    z = F.lit(0).cast("bigint")
    j = before.join(asked, "tile_id", "left").join(after, "tile_id", "left").join(altered, "tile_id", "left")
    return j.select("tile_id", F.coalesce("asked", z).alias("asked"), (F.col("before") - F.coalesce("after", z)).alias("gone"), F.coalesce("altered", z).alias("altered"))


# --- rays -----------------------------------------------------------------------

def ray_hits(rays: DataFrame, tri: DataFrame, reach: float, piece: float = 16.0) -> DataFrame:
    """Intersections of rays (ray_id, ox..oz, unit dx..dz) with faces up to the reach.

    A ray is cut into pieces; a piece meets only the faces near it on the grid, and
    a hit counts in the piece that holds its distance, so nothing is found twice.
    """
    n = max(1, -(-int(reach) // int(piece)))
    r = rays.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"t0": F.col("i") * piece, "t1": F.least((F.col("i") + 1) * piece, F.lit(float(reach)))})
    ends = {a: (F.col(f"o{a}") + F.col(f"d{a}") * F.col("t0"), F.col(f"o{a}") + F.col(f"d{a}") * F.col("t1")) for a in "xz"}
    r = r.withColumns({"ax0": F.least(*ends["x"]), "ax1": F.greatest(*ends["x"]), "az0": F.least(*ends["z"]), "az1": F.greatest(*ends["z"])})
    b = tri.withColumns({f"b{a}{k}": f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]) for a in "xz" for k, f in ((0, F.least), (1, F.greatest))})
    top, low = F.greatest("y1", "y2", "y3"), F.least("y1", "y2", "y3")
    start, stop = F.col("oy") + F.col("dy") * F.col("t0"), F.col("oy") + F.col("dy") * F.col("t1")
    # A metre to spare: heights only save work, the arithmetic below decides.
    p = box_pairs(r, b, base=16.0).where((F.least(start, stop) <= top + 1) & (F.greatest(start, stop) >= low - 1))
    v0, v1, v2 = corners()
    o, d = tuple(F.col(f"o{a}") for a in "xyz"), tuple(F.col(f"d{a}") for a in "xyz")
    e1, e2 = sub(v1, v0), sub(v2, v0)
    p = held(p, dict(zip(("px", "py", "pz", "sx", "sy", "sz"), (*cross(d, e2), *sub(o, v0)))))
    pv, s = tuple(F.col(f"p{a}") for a in "xyz"), tuple(F.col(f"s{a}") for a in "xyz")
    p = held(p, dict(zip(("det", "hx", "hy", "hz"), (dot(e1, pv), *cross(s, e1))))).where(F.abs("det") > 1e-10)
    q = tuple(F.col(f"h{a}") for a in "xyz")
    p = held(p, {"u": dot(s, pv) / F.col("det"), "v": dot(d, q) / F.col("det"), "dist": dot(e2, q) / F.col("det")})
    ok = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") + F.col("v") <= 1) & (F.col("dist") > 0)
    mine = (F.col("dist") >= F.col("t0")) & ((F.col("dist") < F.col("t1")) | ((F.col("i") == n - 1) & (F.col("dist") <= F.col("t1"))))
    return p.where(ok & mine).select("ray_id", "tile_id", "tri_idx", "dist")


def first_hit(hits: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest hits per ray; Spark keeps k per ray before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("ray_id").orderBy("dist", "tri_idx")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def before_blocker(hits: DataFrame, blockers: DataFrame) -> DataFrame:
    """Hits nearer than the first hit of the blocking layer on the same ray."""
    first = blockers.groupBy("ray_id").agg(F.min("dist").alias("block"))
    return hits.join(first, "ray_id", "left").where("block is null or dist < block").drop("block")


def specific_hit(hits: DataFrame, near: float = 0.02) -> DataFrame:
    """Most specific entity among hits within the distance of the first: room or facility, floor, other.

    hits: ray_id, dist, entity_id, type.
    """
    rank = F.when(F.col("type").isin("space", "facility", "connector"), 0).when(F.col("type") == "floor", 1).otherwise(2)
    first = hits.groupBy("ray_id").agg(F.min("dist").alias("first"))
    close = hits.join(first, "ray_id").where(F.col("dist") <= F.col("first") + near)
    return close.groupBy("ray_id").agg(F.min_by(F.struct("entity_id", "dist"), F.struct(rank, "dist", "entity_id")).alias("w")).select("ray_id", "w.*")


def hit_histogram(hits: DataFrame, comp: DataFrame) -> DataFrame:
    """Hits and distinct faces per component."""
    faces = hits.groupBy("tri_idx").agg(F.count("*").alias("n")).join(comp, "tri_idx")
    return faces.groupBy("component").agg(F.sum("n").alias("hits"), F.count("*").alias("faces"))
