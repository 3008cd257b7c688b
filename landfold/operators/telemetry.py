"""Ordered telemetry: intervals, rolling quantiles, blocks, islands, dwell and sessions (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.plans.ordered import lagged, numbered, running

ORDER = ["at", "event_id"]


def frame_intervals(frames: DataFrame, max_gap_ms: float = 1000.0) -> DataFrame:
    """Milliseconds since the session's previous frame; gaps from the maximum on are dropped. frames: session_id, event_id, at (µs), moving."""
    f = lagged(frames, ["session_id"], ORDER, "at", "prev").where("prev is not null")
    return f.withColumn("interval_ms", (F.col("at") - F.col("prev")) / 1000).where(F.col("interval_ms") < max_gap_ms).drop("prev")


def rolling_quantiles(frames: DataFrame, n: int = 240, block: int = 8192) -> DataFrame:
    """p50 and p95 of the last n values per session by the index rule floor(count·p), no interpolation.

    Rows are numbered, cut into equal blocks, and each block gets the n−1 rows before it.
    """
    r = numbered(frames, ["session_id"], ORDER).withColumn("blk", F.floor((F.col("rn") - 1) / block))
    reach = F.floor((F.col("rn") + n - 2) / block)
    r = r.withColumn("in_blk", F.explode(F.sequence("blk", reach)))
    w = Window.partitionBy("session_id", "in_blk").orderBy("rn").rowsBetween(-(n - 1), 0)
    s = r.withColumn("last", F.array_sort(F.collect_list("latency_ms").over(w))).where("blk = in_blk")
    size = F.size("last")

    def at(p: float) -> Column:
        return F.get("last", F.least(size - 1, F.floor(size * F.lit(p)).cast("int")))

    return s.select("session_id", "event_id", size.alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def slow_ratio(frames: DataFrame, block: int = 180, slow_ms: float = 24.0) -> DataFrame:
    """Share of slow frames in each block of consecutive frames of a session."""
    r = numbered(frames, ["session_id"], ORDER).withColumn("block", F.floor((F.col("rn") - 1) / block))
    return r.groupBy("session_id", "block").agg(F.count("*").alias("frames"), F.avg((F.col("latency_ms") > slow_ms).cast("double")).alias("slow"))


def islands(df: DataFrame, keys: list[str], at: str, gap: float, tie: str) -> DataFrame:
    """Rows tagged with the number of their run of neighbours no farther than the gap apart."""
    f = lagged(df, keys, [at, tie], at, "prev")
    f = f.withColumn("starts", (F.col("prev").isNull() | (F.col(at) - F.col("prev") > gap)).cast("int"))
    return running(f, keys, [at, tie], {"island": ("sum", "starts")}).drop("prev", "starts")


def latency_windows(frames: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Exact p50 and p95 per time window."""
    from landfold.plans.ordered import quantiles

    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    f = frames.select(w.alias("w"), "latency_ms").select(F.col("w.start").alias("start"), "latency_ms")
    n = f.groupBy("start").agg(F.count("*").alias("n"), F.max("latency_ms").alias("max"))
    return n.join(quantiles(f, ["start"], "latency_ms", [0.5, 0.95], ["p50", "p95"]), "start")


def hysteresis(events: DataFrame, enter: float = 300.0, leave: float = 330.0) -> DataFrame:
    """Membership after each event: in from enter down, out beyond leave, unchanged between. events: key, at, event_id, distance."""
    says = F.when(F.col("distance") <= enter, True).when(F.col("distance") > leave, False)
    e = running(events.withColumn("says", says), ["key"], ORDER, {"member": ("last", "says")})
    return e.withColumn("member", F.coalesce("member", F.lit(False))).drop("says")


def presence(events: DataFrame, grace_us: int, minimum_us: int) -> DataFrame:
    """Sessions of visibility: a gap longer than the grace ends one, and each lasts the minimum at least. events: key, at, event_id."""
    i = islands(events, ["key"], "at", grace_us, "event_id")
    s = i.groupBy("key", "island").agg(F.min("at").alias("start"), F.max("at").alias("seen"), F.count("*").alias("events"))
    return s.select("key", "start", F.greatest(F.col("seen") + grace_us, F.col("start") + minimum_us).alias("end"), "events")


def retry_schedule(attempts: DataFrame, delays_s=(2, 5, 15)) -> DataFrame:
    """Delay after each failure by how many failures in a row it ends; the last delay repeats. attempts: key, at, event_id, ok."""
    a = running(attempts.withColumn("good", F.col("ok").cast("int")), ["key"], ORDER, {"epoch": ("sum", "good")})
    f = numbered(a.where("not ok"), ["key", "epoch"], ORDER, "failures")
    step = F.least(F.col("failures"), F.lit(len(delays_s))).cast("int")
    return f.select("key", "event_id", "failures", F.element_at(F.array(*[F.lit(d) for d in delays_s]), step).alias("delay_s"))


def coverage_runs(samples: DataFrame) -> DataFrame:
    """Maximal covered and uncovered runs along each line. samples: line_id, s (distance), covered."""
    f = lagged(samples, ["line_id"], ["s"], "covered", "prev")
    f = f.withColumn("starts", (F.col("prev").isNull() | (F.col("prev") != F.col("covered"))).cast("int"))
    f = running(f, ["line_id"], ["s"], {"run": ("sum", "starts")})
    return f.groupBy("line_id", "run").agg(F.max("covered").alias("covered"), F.min("s").alias("start"), F.max("s").alias("end"), F.count("*").alias("samples"))


def line_samples(segments: DataFrame, step: float) -> DataFrame:
    """Points at most step apart along each segment, with the distance from the line's start. segments: line_id, seq, x1..z2."""
    dx, dz = F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")
    s = segments.withColumn("len", F.sqrt(dx * dx + dz * dz)).withColumn("before_by", F.col("seq"))
    s = running(s, ["line_id"], ["seq"], {"end_s": ("sum", "len")}).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("len") / step)))
    s = s.withColumn("i", F.explode(F.sequence(F.when(F.col("seq") == 0, 0).otherwise(1).cast("bigint"), F.col("n"))))
    f = F.col("i") / F.col("n")
    return s.select("line_id", (F.col("end_s") - F.col("len") + F.col("len") * f).alias("s"), (F.col("x1") + dx * f).alias("x"), (F.col("z1") + dz * f).alias("z"))
