"""Counts, roll-ups, registrations, robust planes and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.functions.codecs import mip_bytes
from landfold.plans.ordered import numbered


def category_counts(entities: DataFrame, category: Column) -> DataFrame:
    return entities.groupBy("entity_id").agg(F.max(category).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def registry_counts(entities: DataFrame) -> DataFrame:
    """Entities per type and in total (type NULL), in one pass."""
    return entities.rollup("type").agg(F.count("*").alias("n"))


def group_lines(lines: DataFrame, code: str, name: str, order: str) -> DataFrame:
    """Lines of each code numbered in order, with whether the code has at most one name."""
    names = lines.groupBy(code).agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count("*").alias("lines"))
    one = names.select(code, "lines", F.col("lo").eqNullSafe(F.col("hi")).alias("consistent"))
    return numbered(lines, [code], [order], "position").join(one, code)


def bounds_union(df: DataFrame, key: str, axes: str = "xyz") -> DataFrame:
    return df.groupBy(key).agg(*[F.min(f"min_{a}").alias(f"min_{a}") for a in axes], *[F.max(f"max_{a}").alias(f"max_{a}") for a in axes])


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key (ties to the lower) and the single value where there is only one."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("mode"), F.count("*").alias("values"),
                              F.when(F.count("*") == 1, F.max(value)).alias("single"))


def fit_affine(controls: DataFrame, key: str) -> DataFrame:
    """Least-squares affine map (x, y) to (e, n) per key: coefficients, residual RMSE, leave-one-out RMSE and maximum.

    One pass for the moments, one for the residuals; a point's leave-one-out residual is its residual over
    one minus its leverage, so no point is paired with another. Centred for stability.
    """
    mean = controls.groupBy(key).agg(F.count("*").alias("_k"), *[F.avg(c).alias(f"m{c}") for c in ("x", "y", "e", "n")])
    c = controls.join(mean, key).withColumns({f"c{v}": F.col(v) - F.col(f"m{v}") for v in ("x", "y", "e", "n")})
    s = lambda a, b: F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"s{a}{b}")
    m = c.groupBy(key).agg(s("x", "x"), s("x", "y"), s("y", "y"), s("x", "e"), s("y", "e"), s("x", "n"), s("y", "n"))
    m = m.withColumn("det", F.nullif(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"), F.lit(0.0)))
    for v in ("e", "n"):
        m = m.withColumns({f"a{v}": (F.col(f"sx{v}") * F.col("syy") - F.col(f"sy{v}") * F.col("sxy")) / F.col("det"),
                           f"b{v}": (F.col(f"sy{v}") * F.col("sxx") - F.col(f"sx{v}") * F.col("sxy")) / F.col("det")})
    r = c.join(m, key)
    res = {v: F.col(f"c{v}") - F.col(f"a{v}") * F.col("cx") - F.col(f"b{v}") * F.col("cy") for v in ("e", "n")}
    lever = F.lit(1.0) / F.col("_k") + (F.col("syy") * F.col("cx") * F.col("cx") - 2 * F.col("sxy") * F.col("cx") * F.col("cy") + F.col("sxx") * F.col("cy") * F.col("cy")) / F.col("det")
    r = r.withColumn("sq", res["e"] * res["e"] + res["n"] * res["n"]).withColumn("loo", F.sqrt("sq") / (F.lit(1.0) - lever))
    return r.groupBy(key).agg(
        F.count("*").alias("controls"), *[F.max(f"{p}{v}").alias(f"{p}{v}") for v in ("e", "n") for p in ("a", "b")],
        F.sqrt(F.avg("sq")).alias("rmse"), F.sqrt(F.avg(F.col("loo") * F.col("loo"))).alias("loo_rmse"), F.max("loo").alias("loo_max"))


def fit_plane(points: DataFrame, key: str, draws: int = 180, max_slope: float = 0.42, residual: float = 0.38, seed: int = 7) -> DataFrame:
    """Robust plane y = a·x + b·z + c per key: the trial plane with most inliers, refitted to them.

    The trials come from the 3·draws points per key with the least seeded hashes, a bounded draw; every point
    is tested against every trial of its key in a join and counted by combinable aggregates.
    """
    ticket = F.xxhash64(F.lit(seed), key, "x", "y", "z")
    w = Window.partitionBy(key).orderBy("ticket", "x", "z", "y")
    drawn = points.withColumn("ticket", ticket).withColumn("i", F.row_number().over(w) - 1).where(F.col("i") < 3 * draws)
    tri = drawn.groupBy(key, F.floor(F.col("i") / 3).alias("draw")).agg(
        *[F.max(F.when(F.col("i") % 3 == k, F.col(a))).alias(f"{a}{k}") for k in range(3) for a in "xyz"], F.count("*").alias("n")).where("n = 3")
    d = {f"{a}{k}": F.col(f"{a}{k}") - F.col(f"{a}0") for k in (1, 2) for a in "xyz"}
    det = d["x1"] * d["z2"] - d["z1"] * d["x2"]
    t = tri.withColumn("det", F.nullif(det, F.lit(0.0))).where("det is not null").withColumns({
        "a": (d["y1"] * d["z2"] - d["z1"] * d["y2"]) / F.col("det"), "b": (d["x1"] * d["y2"] - d["y1"] * d["x2"]) / F.col("det")})
    t = t.where(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) <= max_slope).select(
        key, "draw", "a", "b", (F.col("y0") - F.col("a") * F.col("x0") - F.col("b") * F.col("z0")).alias("c"))
    off = F.abs(F.col("y") - F.col("a") * F.col("x") - F.col("b") * F.col("z") - F.col("c"))
    votes = points.join(t, key).where(off < residual).groupBy(key, "draw", "a", "b", "c").agg(F.count("*").alias("inliers"))
    best = votes.groupBy(key).agg(F.min_by(F.struct("a", "b", "c", "inliers"), F.struct(-F.col("inliers"), "draw")).alias("p")).select(key, "p.*")
    inl = points.join(best, key).where(off < residual)
    m = inl.groupBy(key, "inliers").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("z", "z").alias("zz"),
                                        F.covar_pop("x", "z").alias("xz"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("z", "y").alias("zy"), F.var_pop("y").alias("yy"))
    m = m.withColumn("det", F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0)))
    m = m.withColumns({"a": (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / F.col("det"), "b": (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / F.col("det")})
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - F.col("a") * F.col("xy") - F.col("b") * F.col("zy")))
    return m.select(key, "a", "b", (F.col("my") - F.col("a") * F.col("mx") - F.col("b") * F.col("mz")).alias("c"), "inliers", rms.alias("rms"))


def payload_compare(df: DataFrame, key: str, measures: list[str], levels=("high", "fine")) -> DataFrame:
    """Totals per key and level side by side, with null-safe ratios and gains of the second over the first."""
    lo, hi = levels
    p = df.groupBy(key).agg(*[F.sum(F.when(F.col("level") == lv, F.col(m))).alias(f"{lv}_{m}") for lv in levels for m in measures])
    ratios = {f"{m}_ratio": F.round(F.col(f"{hi}_{m}") / F.nullif(F.col(f"{lo}_{m}").cast("double"), F.lit(0.0)), 4) for m in measures}
    return p.withColumns({**ratios, **{f"{m}_gain": F.col(f"{hi}_{m}") - F.col(f"{lo}_{m}") for m in measures}})


def qa_sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement, the same ones for the same seed on any cluster."""
    draw = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256)
    return df.orderBy(draw, *key).limit(n)


def count_bounds(domains: DataFrame) -> DataFrame:
    """Verified lower and scenario upper bound: a verified domain is at least one body; an unsplit one may hold all its named members."""
    return domains.agg(F.count(F.when(F.col("verified"), 1)).alias("lower_bound"),
                       F.sum(F.when(F.col("verified"), F.when(F.col("unsplit"), F.greatest(F.lit(1), "members")).otherwise(1)).otherwise(0)).alias("upper_bound"),
                       F.count("*").alias("domains"))


def unique_content(inventory: DataFrame) -> DataFrame:
    one = inventory.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.count("*").alias("paths"))
    return one.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.col("paths") - 1).alias("duplicates"))


def set_cost(images: DataFrame, masks: DataFrame, key: str, reserve: int = 0) -> DataFrame:
    """Image mip chains, masks once per url, and twice the union grid: (key, bytes).

    images: key, width, height; masks: key, url, width, height, pixel, min_x, min_z, max_x, max_z.
    """
    img = images.groupBy(key).agg(F.sum(mip_bytes("width", "height")).alias("image_bytes"))
    once = masks.dropDuplicates([key, "url"])
    m = once.groupBy(key).agg(F.sum(F.col("width") * F.col("height") * 4).alias("mask_bytes"), F.min("pixel").alias("p"), *[F.min(f"min_{a}").alias(f"lo_{a}") for a in "xz"], *[F.max(f"max_{a}").alias(f"hi_{a}") for a in "xz"])
    grid = F.ceil((F.col("hi_x") - F.col("lo_x")) / F.col("p")) * F.ceil((F.col("hi_z") - F.col("lo_z")) / F.col("p")) * 8
    z = F.lit(0).cast("bigint")
    return img.join(m.select(key, "mask_bytes", grid.alias("union_bytes")), key, "full_outer").select(
        key, (F.coalesce("image_bytes", z) + F.coalesce("mask_bytes", z) + F.coalesce("union_bytes", z) + reserve).alias("bytes"))
