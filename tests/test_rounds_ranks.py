"""Rounds of a shared budget, and ranks of a stream's windows."""

from datetime import datetime, timedelta

from landfold.plans import greedy
from landfold.streaming import runs


def test_groups_that_share_an_unaffordable_item_take_no_round_each(spark, monkeypatch):
    written = []
    monkeypatch.setattr(greedy, "cut_lineage", lambda df, cut=greedy.cut_lineage, **kw: written.append(1) or cut(df, **kw))
    groups = spark.createDataFrame([("s", g, 100 - g) for g in range(12)], "scenario string, group_id long, score long")
    items = spark.createDataFrame([("s", g, i, size) for g in range(12) for i, size in (((1, 99),) if g % 3 else ((2, 40),))], "scenario string, group_id long, item_id long, size long")
    budgets = spark.createDataFrame([("s", 60)], "scenario string, budget long")
    taken = sorted(tuple(r) for r in greedy.greedy_budget(groups, budgets, items).select("group_id", "paid").collect())
    assert taken == [(0, 40), (3, 0), (6, 0), (9, 0)]
    assert len(written) < 25


def test_window_quantiles_of_a_stream_are_exact(spark, tmp_path):
    start, n = datetime(2024, 1, 1), 60_000
    rows = spark.range(n).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 3000) AS ts", "id AS user_id", "CAST(id * 7919 % 60000 AS DOUBLE) AS value")
    late = spark.createDataFrame([(n, start + timedelta(hours=3), 0, 1.0)], "event_id long, ts timestamp, user_id long, value double")
    rows.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = runs.latency_windows(spark, str(tmp_path)).collect()
    assert [(r["n"], r["max"], r["p50"], r["p95"]) for r in got] == [(n, n - 1.0, n / 2 - 1.0, n * 0.95 - 1)]
