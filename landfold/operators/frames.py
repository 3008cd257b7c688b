"""Placements: node-tree matrices, linearised tiles, oriented boxes, hulls, camera rays."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.functions import geodesy
from landfold.functions.geometry import apply_matrix, cross, multiply_matrix, normalise
from landfold.plans.levels import descend
from landfold.session import cut_lineage


def compose_transforms(nodes: DataFrame) -> DataFrame:
    """World matrix of every node reachable from a root: parent's world matrix times its own."""
    own = nodes.select("node_id", "parent_id", F.col("m").alias("local_m"))
    roots = own.where("parent_id is null").select("node_id", F.col("local_m").alias("m"))

    def step(frontier, children):
        return children.join(frontier.withColumnRenamed("node_id", "parent_id"), "parent_id").select(
            "node_id", multiply_matrix("m", "local_m").alias("m")
        )

    return descend(roots, own, step)


def linearise(tiles: DataFrame, origin_e: float, origin_n: float, step: float = 1.0) -> DataFrame:
    """Affine placement of each tile by central differences, and its largest error at the tile's box corners.

    tiles: tile_id, ox, oy, oz (earth-centred origin), radius. Each tile is probed
    at a fixed set of fifteen offsets: its origin, both ways along each axis, and
    the eight corners.
    """
    axes = [(i == 0, i == 1, i == 2) for i in range(3)]
    probes = [(0.0, 0.0, 0.0, 0.0)]
    for axis in axes:
        probes += [(*[s * step * v for v in axis], 0.0) for s in (1.0, -1.0)]
    corners = [(a, b, c) for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    probes += [(*c, 1.0) for c in corners]
    offsets = F.array(*[
        F.struct(F.lit(i).alias("k"), *[F.lit(float(v)).alias(n) for n, v in zip(("fx", "fy", "fz", "scaled"), p)])
        for i, p in enumerate(probes)
    ])
    at = tiles.select("*", F.inline(offsets))
    reach = F.when(F.col("scaled") > 0, F.col("radius")).otherwise(1.0)
    at = at.withColumns({f"p{a}": F.col(f"o{a}") + F.col(f"f{a}") * reach for a in "xyz"})
    at = geodesy.ecef_to_local(at, ("px", "py", "pz"), origin_e, origin_n)
    seen = at.groupBy("tile_id", "radius").agg(*[
        F.max(F.when(F.col("k") == i, F.array("lx", "ly", "lz"))).alias(f"v{i}") for i in range(len(probes))
    ])
    slope = [[(F.col(f"v{1 + 2 * j}")[r] - F.col(f"v{2 + 2 * j}")[r]) / (2 * step) for r in range(3)] for j in range(3)]
    fitted = seen.withColumns({f"j{j}": F.array(*slope[j]) for j in range(3)})
    errors = []
    for i, c in enumerate(corners):
        gaps = [
            F.col(f"v{7 + i}")[r] - (F.col("v0")[r] + sum((F.col(f"j{j}")[r] * F.col("radius") * c[j] for j in range(3)), F.lit(0.0)))
            for r in range(3)
        ]
        errors.append(F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]))
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(*[v for c, w in (("j0", zero), ("j1", zero), ("j2", zero), ("v0", one)) for v in (*[F.col(c)[r] for r in range(3)], w)])
    return fitted.select("tile_id", matrix.alias("matrix"), F.greatest(*errors).alias("max_error"))


def obb_aabb(boxes: DataFrame, key: str) -> DataFrame:
    """World box of an oriented box (centre and three half axes) under a placement matrix."""
    corners = F.array(*[
        F.struct(*[
            (F.col("box")[k] + F.col("box")[3 + k] * a + F.col("box")[6 + k] * b + F.col("box")[9 + k] * c).alias(n)
            for k, n in enumerate("xyz")
        ])
        for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)
    ])
    c = boxes.select(key, "m", F.inline(corners))
    world = dict(zip("xyz", apply_matrix("m", "x", "y", "z")))
    c = c.select(key, *[v.alias(n) for n, v in world.items()])
    return c.groupBy(key).agg(
        *[F.min(n).alias(f"min_{n}") for n in "xyz"], *[F.max(n).alias(f"max_{n}") for n in "xyz"]
    )


HULL_PARTS, HULL_SMALL, HULL_FEW = 64, 64, 4096


def convex_hull(points: DataFrame, key: str, parts: int = HULL_PARTS) -> DataFrame:
    """Vertices of the hull of each key's points, counter-clockwise, as (key, seq, x, z).

    Of the points with one x only the lowest and highest z can be vertices, and the other
    way round: two combinable aggregates drop the rest. Keys of up to HULL_SMALL points left are
    lists in rows, many to a call of Python. A key with more than HULL_FEW points left
    is cut into parts by hash, each part keeps its own hull, and only those meet.
    """
    def chain(xz):
        pts = sorted(set(map(tuple, xz)))
        if len(pts) < 3:
            return pts

        def half(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return half(pts) + half(pts[::-1])

    def finish(k, pdf):
        return pd.DataFrame([(k[0], i, x, z) for i, (x, z) in enumerate(chain(pdf[["x", "z"]].to_numpy()))], columns=[key, "seq", "x", "z"])

    @F.pandas_udf("array<struct<x: double, z: double>>")
    def rings(xs: pd.Series, zs: pd.Series) -> pd.Series:
        return pd.Series([[{"x": u, "z": v} for u, v in chain(zip(x.tolist(), z.tolist()))] for x, z in zip(xs, zs)], dtype=object)

    def extremes(df, along, across):
        ends = df.groupBy(key, along).agg(F.array_distinct(F.array(F.min(across), F.max(across))).alias("ends"))
        return ends.select(key, along, F.explode("ends").alias(across))

    schema = f"{key} {dict(points.dtypes)[key]}, seq long, x double, z double"
    slim = extremes(extremes(points, "x", "z"), "z", "x").select(key, "x", "z")
    slim = cut_lineage(slim)
    sizes = slim.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HULL_SMALL)
    small, rest = slim.join(sizes, key, "left_anti"), slim.join(sizes, key)
    folded = small.groupBy(key).agg(F.collect_list(F.struct("x", "z")).alias("points")).select(key, F.posexplode(rings("points.x", "points.z")).alias("seq", "p"))
    folded = folded.select(key, F.col("seq").cast("bigint").alias("seq"), "p.x", "p.z")
    few, many = rest.where(F.col("n") <= HULL_FEW), rest.where(F.col("n") > HULL_FEW)
    halfway = many.select(key, "x", "z").withColumn("part", F.pmod(F.xxhash64("x", "z"), F.lit(parts))).groupBy(key, "part").applyInPandas(finish, schema)
    # An explicit number of partitions keeps AQE from folding small groups into one Python worker.
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folded.unionByName(few.select(key, "x", "z").unionByName(halfway.select(key, "x", "z")).repartition(spread, key).groupBy(key).applyInPandas(finish, schema))


def hull_area(hull: DataFrame, key: str) -> DataFrame:
    """Vertex count and area of each hull by the shoelace sum over successive vertices."""
    hull = cut_lineage(hull)
    sizes = hull.groupBy(key).agg(F.count("*").alias("vertices"))
    a = hull.join(sizes, key)
    b = hull.select(key, F.col("seq").alias("next"), F.col("x").alias("nx"), F.col("z").alias("nz"))
    ring = a.withColumn("next", (F.col("seq") + 1) % F.col("vertices")).join(b, [key, "next"])
    return ring.groupBy(key, "vertices").agg(
        F.round(F.sum(F.col("x") * F.col("nz") - F.col("nx") * F.col("z")) / 2, 6).alias("area")
    )


def pixel_rays(poses: DataFrame, width: int, height: int, fov_degrees: float, cols: tuple[int, int], rows: tuple[int, int]) -> DataFrame:
    """Unit direction of the ray through every pixel of a region, for cameras looking along (fx, fy, fz)."""
    forward = normalise(tuple(F.col(f"f{a}") for a in "xyz"))
    zero, one = F.lit(0.0), F.lit(1.0)
    half = math.tan(math.radians(fov_degrees / 2))
    p = poses.withColumns(dict(zip(("fx", "fy", "fz"), forward)))
    p = p.withColumns(dict(zip(("rx", "ry", "rz"), normalise(cross(tuple(F.col(f"f{a}") for a in "xyz"), (zero, one, zero))))))
    p = p.withColumns(dict(zip(("ux", "uy", "uz"), cross(tuple(F.col(f"r{a}") for a in "xyz"), tuple(F.col(f"f{a}") for a in "xyz")))))
    p = p.withColumn("col_no", F.explode(F.sequence(F.lit(cols[0]), F.lit(cols[1])))).withColumn(
        "row_no", F.explode(F.sequence(F.lit(rows[0]), F.lit(rows[1])))
    )
    a = ((F.col("col_no") + 0.5) / width * 2 - 1) * F.lit(half * width / height)
    b = (F.lit(1.0) - (F.col("row_no") + 0.5) / height * 2) * F.lit(half)
    d = normalise(tuple(F.col(f"f{k}") + a * F.col(f"r{k}") + b * F.col(f"u{k}") for k in "xyz"))
    return p.select("pose_id", "row_no", "col_no", d[0].alias("dx"), d[1].alias("dy"), d[2].alias("dz"))
