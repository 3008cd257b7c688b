"""Order-dependent computations without gathering a key into one task.

Rows are range-partitioned once along the keys and every order column, and written with the number of their
partition, the chunk. Equal leading values are split by the columns after them, and a key of any size spreads over as
many chunks as it fills. Windows run inside a (key, chunk); what they need from earlier chunks is carried over by a
window on one summary row per (key, chunk), of which there are at most keys plus chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.session import cut_lineage


def with_chunks(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows, written once, with chunk: non-decreasing along keys and order."""
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(pieces, *keys, *order).withColumn("chunk", F.spark_partition_id()))


def _matched(df: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the summaries of (key, chunk) to the rows; null keys are keys."""
    renamed = parts.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "chunk")], *[c for c in parts.columns if c not in (*keys, "chunk")])
    same = F.col("chunk") == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, same).drop(*[f"_k_{c}" for c in (*keys, "chunk")])


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rn") -> DataFrame:
    """row_number per key."""
    df = with_chunks(df, keys, order)
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order)
    sizes = df.groupBy(*keys, "chunk").agg(F.count("*").alias("size"))
    along = Window.partitionBy(*keys).orderBy("chunk")
    offsets = sizes.select(*keys, "chunk", (F.sum("size").over(along) - F.col("size")).alias("before"))
    return _matched(df.withColumn(name, F.row_number().over(inside)), offsets, keys).withColumn(name, F.col(name) + F.col("before")).drop("chunk", "before")


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Previous value per key along the ascending order columns."""
    df = with_chunks(df, keys, order)
    last = df.groupBy(*keys, "chunk").agg(F.max_by(value, F.struct(*order)).alias("tail"))
    carry = last.withColumn("tail", F.lag("tail").over(Window.partitionBy(*keys).orderBy("chunk")))
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order)
    first = F.row_number().over(inside) == 1
    out = _matched(df.withColumns({name: F.lag(value).over(inside), "is_first": first}), carry, keys)
    return out.withColumn(name, F.when(F.col("is_first"), F.col("tail")).otherwise(F.col(name))).drop("chunk", "tail", "is_first")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]], exclusive: bool = False) -> DataFrame:
    """Running aggregates per key: {name: (kind, column)} with kind sum, max or last (non-NULL).

    exclusive leaves the current row out.
    """
    df = with_chunks(df, keys, order)
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))}
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    join = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
            "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    parts = df.groupBy(*keys, "chunk").agg(*[fold[k](c).alias(f"_{n}") for n, (k, c) in values.items()])
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "chunk", *[over[k](f"_{n}").over(before).alias(f"_{n}") for n, (k, _) in values.items()])
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = _matched(df.withColumns({n: over[k](c).over(inside) for n, (k, c) in values.items()}), parts, keys)
    return out.withColumns({n: join[k](F.col(f"_{n}"), F.col(n)) for n, (k, _) in values.items()}).drop("chunk", *[f"_{n}" for n in values])


def quantiles(df: DataFrame, keys: list[str], value: str, ps: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles per key with linear interpolation between ranks, from running counts over distinct values.

    Equal values combine before the shuffle, so ties cost nothing.
    """
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = running(v.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), keys, ["_v"], {"_to": ("sum", "_n")})
    counted = cut_lineage(counted)
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    at = [F.lit(float(p)) * (F.col("_all") - 1) for p in ps]
    whole = counted.join(total, keys) if keys else counted.crossJoin(F.broadcast(total))  # one row
    picks = [F.min(F.when(F.col("_to") > f(a), F.col("_v"))).alias(f"_{i}{s}") for i, a in enumerate(at) for s, f in (("lo", F.floor), ("hi", F.ceil))]
    out = whole.groupBy(*keys, "_all").agg(*picks)
    return out.select(*keys, *[(F.col(f"_{i}lo") + (F.col(f"_{i}hi") - F.col(f"_{i}lo")) * (at[i] - F.floor(at[i]))).alias(n) for i, n in enumerate(names)])
