"""Session telemetry: batch results with oracles, and the streams run over the event table."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.catalogue.ordering import frames
from landfold.operators import telemetry as tm
from landfold.streaming import runs


@query("l1_latency_windows", "SELECT date_trunc('hour',ts) AS start, count(*) AS n, max(latency_ms) AS max, round(quantile_cont(latency_ms,5e-1),9) AS p50, round(quantile_cont(latency_ms,95e-2),9) AS p95 FROM frames GROUP BY 1")
def _(t):
    return tm.latency_windows(t.frames).withColumns({"p50": F.round("p50", 9), "p95": F.round("p95", 9)})


DIST = "ev AS (SELECT session_id AS key, event_id, epoch_us(ts) AS us, latency_ms*6 AS distance FROM frames)"


def distances(t):
    return frames(t).select(F.col("session_id").alias("key"), "event_id", "at", (F.col("latency_ms") * 6).alias("distance"))


@query("l2_hysteresis", f"WITH {DIST} SELECT key, event_id, coalesce(last_value(CASE WHEN distance<=300 THEN TRUE WHEN distance>330 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), FALSE) AS member FROM ev")
def _(t):
    return tm.hysteresis(distances(t)).select("key", "event_id", "member")


@query("l5_presence", f"WITH {DIST}, st AS (SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY key ORDER BY us, event_id)<=7200000000 THEN 0 ELSE 1 END AS st FROM ev), g AS (SELECT *, sum(st) OVER (PARTITION BY key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM st) SELECT key, min(us) AS start, greatest(max(us)+7200000000, min(us)+28800000000) AS \"end\", count(*) AS events FROM g GROUP BY key, isl")
def _(t):
    return tm.presence(distances(t), 7_200_000_000, 28_800_000_000)


@query("l7_retry_schedule", """WITH a AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, event_type<>'error' AND event_type<>'view' AND event_type<>'click' AS ok FROM events), e AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY key, ep ORDER BY us, event_id) AS failures FROM e WHERE NOT ok) SELECT key, event_id, failures, CASE failures WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 15 END AS delay_s FROM f""")
def _(t):
    a = t.events.select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    return tm.retry_schedule(a)


@query("l1_latency_windows_stream", """SELECT date_trunc('hour',ts) AS start, count(*) AS n, max(latency_ms) AS max, quantile_disc(latency_ms,5e-1) AS p50, quantile_disc(latency_ms,95e-2) AS p95 FROM frames GROUP BY 1
HAVING date_trunc('hour',ts)+INTERVAL 1 HOUR <= (SELECT max(ts)-INTERVAL 10 MINUTE FROM frames)""")
def _(t):
    return runs.latency_windows(t.spark, t.sf_dir)


@query("l5_presence_stream", f"""WITH {DIST}, st AS (SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY key ORDER BY us, event_id)<7200000000 THEN 0 ELSE 1 END AS st FROM ev), g AS (SELECT *, sum(st) OVER (PARTITION BY key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM st)
SELECT key, make_timestamp(min(us)) AS start, make_timestamp(greatest(max(us)+7200000000, min(us)+28800000000)) AS "end", count(*) AS events FROM g GROUP BY key, isl HAVING max(us)+7200000000 <= (SELECT CAST(floor(max(us)/1000e0) AS BIGINT)*1000-600000000 FROM ev)""")
def _(t):
    return runs.presence(t.spark, t.sf_dir, "2 hours", "8 hours")


# A stream has answered for every row the watermark has passed.
PASSED = "us <= (SELECT CAST(floor(max(us)/1000e0) AS BIGINT)*1000-600000000 FROM ev)"


@query("l2_hysteresis_stream", f"WITH {DIST} SELECT key, event_id, coalesce(last_value(CASE WHEN distance<=300 THEN TRUE WHEN distance>330 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), FALSE) AS member FROM ev WHERE {PASSED}")
def _(t):
    return runs.hysteresis(t.spark, t.sf_dir)


@query("l3_dwell_choice_stream")
def _(t):
    return runs.dwell_choice(t.spark, t.sf_dir)


@query("l4_adaptive_level_stream")
def _(t):
    return runs.adaptive_level(t.spark, t.sf_dir)


@query("l6_stable_order_stream")
def _(t):
    return runs.stable_order(t.spark, t.sf_dir)


@query("l8_violation_feed_stream", """WITH a AS (SELECT CASE WHEN event_id%5=0 THEN '../' ELSE '' END||event_type||'/'||event_id AS path, substr(sha256(CAST(event_id AS VARCHAR)), 1, CASE WHEN event_id%7=3 THEN 63 ELSE 64 END) AS sha256, event_id AS k FROM events)
SELECT path, sha256, 'bad-path' AS rule FROM a WHERE k%5=0 UNION ALL SELECT path, sha256, 'bad-sha256' FROM a WHERE k%7=3 UNION ALL SELECT path, sha256, 'bad-size' FROM a WHERE k%11=4""")
def _(t):
    return runs.violation_feed(t.spark, t.sf_dir)
