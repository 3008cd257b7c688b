"""Connected components by alternating large-star and small-star rounds.

Every round is a minimum per node (combined before the shuffle) joined back to
the edges; no node's neighbours are ever listed, so a hub may touch any share of
the graph. The number of rounds grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the least id of each component; nodes: id; edges: u, v."""
    e = cut_lineage(edges.where("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        e = cut_lineage(_small_star(_large_star(e)), replaces=e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(e.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
