"""Streams over a table folder, run to the end of what is there and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.functions.text import safe_path, valid_sha256
from landfold.plans.ordered import running
from landfold.session import checkpoint_dir
from landfold.streaming import state


def read_table(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream of a table's files, with the schema of the table as it is now."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}*.parquet")


def run_counted(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """Process all available input into a table in the shared folder; that table, and how many rows came too late for any stateful step."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/landfold-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").format("parquet").option("path", f"{base}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    late = sum(int(op["numRowsDroppedByWatermark"]) for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{base}/rows"), late


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    return run_counted(stream, mode)[0]


def events(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return e.withColumns({"key": F.col("user_id"), "at": F.unix_micros("ts")})


def latency_windows(spark: SparkSession, folder: str, width: str = "1 hour") -> DataFrame:
    """Windows the watermark has closed, with exact p50 and p95, values of the window; later rows are dropped.

    The stream counts the distinct values of a window, so that no window is gathered; their ranks are read off once it is closed.
    """
    counted = events(spark, folder).groupBy(F.window("ts", width).alias("w"), "value").agg(F.count("*").alias("rows"))
    closed = run_to_end(counted.select(F.col("w.start").alias("start"), "value", "rows"))
    ranked = running(closed.where("value is not null"), ["start"], ["value"], {"upto": ("sum", "rows")})
    total = closed.groupBy("start").agg(F.sum("rows").alias("n"), F.max("value").alias("max"), F.sum(F.when(F.col("value").isNotNull(), F.col("rows"))).alias("known"))
    rank = {n: F.greatest(F.lit(1), F.col("known") - F.floor(F.col("known") - F.col("known") * F.lit(p))) for n, p in (("p50", 0.5), ("p95", 0.95))}
    picked = ranked.select("start", "value", "upto").join(total, "start").groupBy("start").agg(*[F.min(F.when(F.col("upto") >= r, F.col("value"))).alias(n) for n, r in rank.items()])
    return total.join(picked, "start", "left").select("start", "n", "max", "p50", "p95")


def presence(spark: SparkSession, folder: str, grace: str, minimum: str) -> DataFrame:
    s = events(spark, folder).groupBy("key", F.session_window("ts", grace).alias("w")).agg(F.count("*").alias("events"))
    end = F.greatest(F.col("w.end"), F.col("w.start") + F.expr(f"INTERVAL {minimum}"))
    return run_to_end(s.select("key", F.col("w.start").alias("start"), end.alias("end"), "events"))


#: a user's candidates are those of one hour of events
FRAME_MS = 3_600_000.0


def _folded(spark: SparkSession, folder: str, fold, **columns) -> DataFrame:
    return run_to_end(state.folded(events(spark, folder).select("key", "ts", "at", "event_id", *[c.alias(n) for n, c in columns.items()]), fold))


def hysteresis(spark: SparkSession, folder: str) -> DataFrame:
    return _folded(spark, folder, state.Membership(), distance=F.col("value") * 6)


def dwell_choice(spark: SparkSession, folder: str) -> DataFrame:
    return _folded(spark, folder, state.Choice(FRAME_MS, 2.5 * FRAME_MS, 9 * FRAME_MS), cand=F.col("event_type"), score=F.col("value"))


def adaptive_level(spark: SparkSession, folder: str) -> DataFrame:
    return _folded(spark, folder, state.QualityLevel(block=18), ms=F.col("value"))


def stable_order(spark: SparkSession, folder: str) -> DataFrame:
    return _folded(spark, folder, state.Ranking(FRAME_MS), cand=F.col("event_type"), score=F.col("value"))


def check_assets(assets: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of (path, sha256, rule, ts): each broken rule of a (path, sha256) once within the delay, however often the asset comes.

    assets: a stream of path, sha256, bytes, ts. An asset may break several rules. The state holds one key per violation
    until the watermark has passed it by the delay.
    """
    wrong = F.array_compact(F.array(F.when(~F.coalesce(safe_path("path"), F.lit(False)), "bad-path"), F.when(~F.coalesce(valid_sha256("sha256"), F.lit(False)), "bad-sha256"),
                                    F.when(F.coalesce(F.col("bytes") < 0, F.lit(True)), "bad-size")))
    found = assets.withWatermark("ts", delay).select("path", "sha256", F.explode(wrong).alias("rule"), "ts")
    return found.dropDuplicatesWithinWatermark(["path", "sha256", "rule"])


def violation_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Assets named by the event stream, each seen several times, checked as they arrive."""
    e, k = read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    digest = F.sha2(k.cast("string"), 256)
    assets = e.select(F.concat(F.when(k % 5 == 0, "../").otherwise(""), "event_type", F.lit("/"), k).alias("path"), F.when(k % 7 == 3, F.substring(digest, 1, 63)).otherwise(digest).alias("sha256"),
                      F.when(k % 11 == 4, -1).otherwise(k).alias("bytes"), "ts", F.explode(F.sequence(F.lit(0), k % 3)).alias("again"))
    return run_to_end(check_assets(assets.drop("again"))).select("path", "sha256", "rule")
