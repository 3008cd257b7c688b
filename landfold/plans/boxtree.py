"""The nearest of many boxes to each of some wide ones, without meeting all that a wide one covers.

Boxes lie in cells of cells. Each cell holds the bounds of its boxes and two of them, of different keys if it has any. A
wide box starts at the widest cells; the boxes it meets there bound its distance from above, and only cells that could
hold a nearer one are opened. So a box that touches another is done as soon as it meets it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.plans.gridjoin import held, spread
from landfold.session import cut_lineage

#: a cell's sides as multiples of those it holds, and the most cells that every wide box starts at
FAN, TOP = 4, 64
CELL = ["gx", "gy", "gz"]
BOUNDS = [f"{n}{c}" for n in ("lo", "hi") for c in "xyz"]


def box_gap(of: str = "") -> Column:
    """Distance between the box alox..ahiz and the box blox..bhiz, which may be fields of a struct."""
    b = f"{of}." if of else ""
    gap = [F.greatest(F.lit(0.0), F.col(f"{b}blo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"{b}bhi{c}")) for c in "xyz"]
    return F.sqrt(sum((g * g for g in gap), F.lit(0.0)))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Cells of each level, the finest first; each level is made from the one before it."""
    one = F.struct("b", *[f"b{n}" for n in BOUNDS])
    rows, out = leaves.select(*CELL, *[f"b{n}" for n in BOUNDS], one.alias("first"), one.alias("last")), []
    while not out or out[-1].count() > TOP:
        bounds = [(F.min if n.startswith("lo") else F.max)(f"b{n}").alias(f"b{n}") for n in BOUNDS]
        out.append(cut_lineage(rows.groupBy(*CELL).agg(*bounds, F.min_by("first", F.col("first.b")).alias("first"), F.max_by("last", F.col("last.b")).alias("last"))))
        rows = out[-1].withColumns({c: F.floor(F.col(c) / FAN).cast("bigint") for c in CELL})
    return out


def nearest_boxes(a: DataFrame, b: DataFrame, reach: float, cell: float) -> DataFrame:
    """(a, d): distance from each box (a, alox..ahiz) to the nearest box (b, blox..bhiz) of another key, if within the reach.

    cell: side of the finest cells, about that of the space in which one box of b has a few others.
    """
    mine = ["a", *[f"a{n}" for n in BOUNDS]]
    up = {c: f"up_{c}" for c in CELL}
    leaves = b.withColumns({f"g{c}": F.floor(F.col(f"blo{c}") / cell).cast("bigint") for c in "xyz"})
    levels = _levels(leaves)
    met, rows, found = a.select(*mine, F.lit(None).cast("double").alias("best")).crossJoin(levels[-1]), None, []
    for k in reversed(range(len(levels))):
        high = F.least(*[F.when(F.col(f"{w}.b") != F.col("a"), box_gap(w)) for w in ("first", "last")])
        met = held(met, {"low": box_gap(), "high": high}).where((F.col("low") <= reach) & ((F.col("first.b") != F.col("a")) | (F.col("last.b") != F.col("a"))))
        rows = cut_lineage(met.select(*mine, "best", *CELL, "low", "high"), replaces=rows)
        best = cut_lineage(rows.groupBy("a").agg(F.min(F.least("best", "high")).alias("best")))
        found.append(best.select("a", F.col("best").alias("d")))
        go = rows.drop("best").join(spread(best), "a").where("best is null or low < best").select(*mine, "best", *[F.col(c).alias(up[c]) for c in CELL])
        inner = levels[k - 1].withColumns({up[c]: F.floor(F.col(c) / FAN).cast("bigint") for c in CELL}) if k else leaves.withColumnsRenamed(up)
        met = go.join(spread(inner), list(up.values()))
    found.append(met.where("a <> b").select("a", box_gap().alias("d")))
    return reduce(DataFrame.unionByName, found).where(F.col("d") <= reach).groupBy("a").agg(F.min("d").alias("d"))
