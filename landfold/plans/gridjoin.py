"""Grid-key equi-joins in place of spatial cross joins.

A box lives on the coarsest level whose cells are at least as wide as the box,
so it covers at most four cells whatever its size. Probes visit one cell per
level in use. Each true pair meets in exactly one cell, so nothing has to be
de-duplicated, and AQE can split a crowded cell like any other join key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("bx0", "bz0", "bx1", "bz1")


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that Spark must not broadcast.

    Its rows were multiplied by an explode, or unpacked from keys that take hardly any room in a file, and Spark
    estimates it by what it was made from: it would send the driver many times the broadcast threshold.
    """
    return df.hint("merge")


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once per row: filters on them are not moved below, where they would repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _level(extent: Column, base: float) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(base)) / F.lit(base))).cast("int"))


def with_level(boxes: DataFrame, base: float, box=BOX) -> DataFrame:
    x0, z0, x1, z1 = box
    extent = F.greatest(F.col(x1) - F.col(x0), F.col(z1) - F.col(z0))
    return boxes.withColumn("lvl", _level(extent, base))


def levels_of(boxes: DataFrame) -> list[int]:
    """Levels in use: at most a few dozen integers, whatever the number of boxes."""
    return sorted(r["lvl"] for r in boxes.select("lvl").distinct().collect())


def _size(level: Column, base: float) -> Column:
    return F.lit(float(base)) * F.pow(F.lit(2.0), level)


def _cells(df: DataFrame, base: float, box) -> DataFrame:
    x0, z0, x1, z1 = box
    size = _size(F.col("lvl"), base)
    cell = lambda c: F.floor(F.col(c) / size).cast("bigint")
    return df.withColumn("gx", F.explode(F.sequence(cell(x0), cell(x1)))).withColumn(
        "gz", F.explode(F.sequence(cell(z0), cell(z1)))
    )


def points_in_boxes(points: DataFrame, boxes: DataFrame, base: float = 32.0, x: str = "x", z: str = "z", box=BOX) -> DataFrame:
    """Every (point, box) pair with the point in the closed box. Column names must not clash."""
    boxes = with_level(boxes, base, box)
    levels = levels_of(boxes) or [0]
    boxes = _cells(boxes, base, box)
    probe = points.withColumn("lvl", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = _size(F.col("lvl"), base)
    probe = probe.withColumn("gx", F.floor(F.col(x) / size).cast("bigint")).withColumn(
        "gz", F.floor(F.col(z) / size).cast("bigint")
    )
    inside = F.col(x).between(F.col(box[0]), F.col(box[2])) & F.col(z).between(F.col(box[1]), F.col(box[3]))
    return probe.join(spread(boxes), ["lvl", "gx", "gz"]).where(inside).drop("lvl", "gx", "gz")


def box_pairs(a: DataFrame, b: DataFrame, base: float = 32.0, box_a=("ax0", "az0", "ax1", "az1"), box_b=BOX) -> DataFrame:
    """Every pair of overlapping boxes (touching counts), each once.

    The finer box of a pair is looked up on the level of the coarser one; the
    pair is kept only in the cell that holds the corner of their intersection.
    """
    a, b = with_level(a, base, box_a), with_level(b, base, box_b)
    levels = sorted(set(levels_of(a)) | set(levels_of(b))) or [0]

    def own(df, box):
        return _cells(df, base, box)

    def coarser(df, box, strict: bool):
        ladder = F.array(*[F.lit(v) for v in levels])
        keep = (lambda v: v > F.col("lvl")) if strict else (lambda v: v >= F.col("lvl"))
        return _cells(df.withColumn("lvl", F.explode(F.filter(ladder, keep))), base, box)

    size = _size(F.col("lvl"), base)
    corner = (
        (F.floor(F.greatest(F.col(box_a[0]), F.col(box_b[0])) / size) == F.col("gx"))
        & (F.floor(F.greatest(F.col(box_a[1]), F.col(box_b[1])) / size) == F.col("gz"))
    )
    overlap = (
        (F.col(box_a[0]) <= F.col(box_b[2])) & (F.col(box_b[0]) <= F.col(box_a[2]))
        & (F.col(box_a[1]) <= F.col(box_b[3])) & (F.col(box_b[1]) <= F.col(box_a[3]))
    )
    halves = [
        own(a, box_a).join(spread(coarser(b, box_b, strict=False)), ["lvl", "gx", "gz"]),
        coarser(a, box_a, strict=True).join(spread(own(b, box_b)), ["lvl", "gx", "gz"]),
    ]
    return reduce(DataFrame.unionByName, [h.where(overlap & corner).drop("lvl", "gx", "gz") for h in halves])
