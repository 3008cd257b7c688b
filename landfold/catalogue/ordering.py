"""Ranks, intervals, rolling windows and runs."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.operators import telemetry as tm
from landfold.plans.ordered import numbered


def frames(t):
    return t.frames.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


AT = "f0 AS (SELECT session_id, event_id, epoch_us(ts) AS us, latency_ms, moving FROM frames)"


@query("f1_rank", "SELECT group_id, score, row_number() OVER (ORDER BY score DESC, group_id) AS rank FROM budget_group")
def _(t):
    return numbered(t.budget_group.select("group_id", "score"), [], [F.col("score").desc(), "group_id"], "rank")


@query("f5_frame_intervals", f"WITH {AT}, l AS (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS prev FROM f0) SELECT session_id, event_id, moving, (us-prev)/1000 AS interval_ms FROM l WHERE prev IS NOT NULL AND (us-prev)/1000 < 6e6")
def _(t):
    return tm.frame_intervals(frames(t), max_gap_ms=6e6).select("session_id", "event_id", "moving", "interval_ms")


@query("f6_rolling_quantiles", f"""WITH {AT}, w AS (SELECT session_id, event_id, list_sort(list(latency_ms) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)) AS l FROM f0)
SELECT session_id, event_id, CAST(len(l) AS INTEGER) AS samples, l[CAST(floor(len(l)*5e-1) AS INTEGER)+1] AS p50, l[least(len(l), CAST(floor(len(l)*95e-2) AS INTEGER)+1)] AS p95 FROM w""")
def _(t):
    return tm.rolling_quantiles(frames(t))


@query("f7_slow_ratio", f"""WITH {AT}, r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY us, event_id)-1)/18e0) AS BIGINT) AS block FROM f0) SELECT session_id, block, count(*) AS frames, round(avg(CASE WHEN latency_ms>24 THEN 1e0 ELSE 0e0 END),9) AS slow FROM r GROUP BY 1,2""")
def _(t):
    return tm.slow_ratio(frames(t), block=18).withColumn("slow", F.round("slow", 9))


@query("f8_islands", f"""WITH {AT}, l AS (SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) <= 7200000000 THEN 0 ELSE 1 END AS st FROM f0) SELECT session_id, event_id, CAST(sum(st) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM l""")
def _(t):
    return tm.islands(frames(t), ["session_id"], "at", 7_200_000_000, "event_id").select("session_id", "event_id", "island")


LEN = "sqrt((x2-x1)*(x2-x1)+(z2-z1)*(z2-z1))"


@query("f9_coverage_runs", f"""WITH sg AS (SELECT line_id, seq, x1,z1,x2,z2, {LEN} AS len, sum({LEN}) OVER (PARTITION BY line_id ORDER BY seq) AS end_s FROM road_seg), sm AS (SELECT line_id, end_s-len+len*(i/CAST(ceil(len/2e0) AS DOUBLE)) AS s, x1+(x2-x1)*(i/CAST(ceil(len/2e0) AS DOUBLE)) AS x, z1+(z2-z1)*(i/CAST(ceil(len/2e0) AS DOUBLE)) AS z FROM sg, range(0,60) q(i) WHERE i<=ceil(len/2e0) AND (seq=0 OR i>0)),
cv AS (SELECT sm.*, m.row_no IS NOT NULL AS covered FROM sm LEFT JOIN (SELECT DISTINCT row_no, col_no FROM mask_cell WHERE r>127) m ON m.row_no=floor(z/8) AND m.col_no=floor(x/8)),
st AS (SELECT *, CASE WHEN lag(covered) OVER (PARTITION BY line_id ORDER BY s) = covered THEN 0 ELSE 1 END AS st FROM cv), g AS (SELECT *, sum(st) OVER (PARTITION BY line_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM st)
SELECT line_id, CAST(run AS BIGINT) AS run, bool_or(covered) AS covered, round(min(s),6) AS start, round(max(s),6) AS "end", count(*) AS samples FROM g GROUP BY 1,2""")
def _(t):
    s = tm.line_samples(t.road_seg.select("line_id", "seq", "x1", "z1", "x2", "z2"), 2.0)
    held = t.mask_cell.where("r>127").select("row_no", "col_no").distinct().withColumn("held", F.lit(True))
    s = s.withColumns({"row_no": F.floor(F.col("z") / 8), "col_no": F.floor(F.col("x") / 8)}).join(held, ["row_no", "col_no"], "left")
    runs = tm.coverage_runs(s.select("line_id", "s", F.coalesce("held", F.lit(False)).alias("covered")))
    return runs.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})
