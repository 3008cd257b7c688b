"""Files written here, scanned back; streams fed in several batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from landfold.operators import telemetry as tm
from landfold.sources import releases, scans
from landfold.streaming import runs, state


def test_manifest_and_registry(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "bundles": [{"id": "a", "tiles": [{"url": "x", "bytes": 3}, {"url": "y", "bytes": 4}]}, {"id": "b", "tiles": [{"url": "z", "bytes": 5}]}]}))
    m = scans.read_manifest(spark, str(tmp_path / "m.json"), "version int, bundles array<struct<id: string, tiles: array<struct<url: string, bytes: long>>>>", "bundles", "tiles")
    assert sorted((r.id, r.url, r.bytes) for r in m.collect()) == [("a", "x", 3), ("a", "y", 4), ("b", "z", 5)]
    (tmp_path / "r.json").write_text('{"entity_id":"b:1","type":"building","name":"N"}\n{"entity_id":"b:2","type":"building"}\n{oops\n')
    r = scans.read_registry(spark, str(tmp_path / "r.json"), "PERMISSIVE")
    assert {tuple(x.errors) for x in r.collect()} >= {(), ("name",)}
    with pytest.raises(Exception):
        scans.read_registry(spark, str(tmp_path / "r.json")).collect()


def test_geojson_gml(spark, tmp_path):
    sq = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"crs": {"properties": {"name": "EPSG:1"}}, "features": [
        {"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": sq}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [sq, sq]}},
        {"properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 2]]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    g = scans.read_geojson(spark, str(tmp_path / "f.json"), "EPSG:1")
    assert {(r.kind, r.n) for r in g.groupBy("kind").agg(F.count("x").alias("n")).collect()} == {("Polygon", 4), ("MultiPolygon", 8), ("LineString", 2), ("Point", 0)}
    with pytest.raises(Exception):
        scans.read_geojson(spark, str(tmp_path / "f.json"), "EPSG:2").collect()
    (tmp_path / "f.gml").write_text("<c><m><id>7</id><posList>1 2 0 1 2 0 3 4 5</posList></m></c>")
    v = scans.read_gml(spark, str(tmp_path / "f.gml"), "m", "id long, posList string").collect()
    assert [(r.id, r.seq, r.x, r.y, r.h) for r in v] == [(7, 0, 2.0, 1.0, 0.0), (7, 1, 4.0, 3.0, 5.0)]


def test_assets(spark, tmp_path):
    import struct

    def glb(doc, version=2, extra=0):
        j = json.dumps(doc).encode()
        return b"glTF" + struct.pack("<III4s", version, 20 + len(j) + extra, len(j), b"JSON") + j

    (tmp_path / "ok.glb").write_bytes(glb({"a": 1}))
    (tmp_path / "bad.glb").write_bytes(glb({"images": [{"uri": "x.png"}]}, 1, 9))
    got = {r.path.split("/")[-1]: set(r.violations) for r in scans.scan_assets(spark, f"{tmp_path}/*.glb").collect()}
    assert got == {"ok.glb": set(), "bad.glb": {"version", "declared-length", "external-dependency"}}


def test_publish(spark, tmp_path):
    inv = lambda n: spark.createDataFrame([(f"/{i}", i, "s") for i in range(n)], "path string, bytes long, sha256 string")
    root = str(tmp_path / "rel")
    first = releases.publish(inv(3), root)
    second = releases.publish(inv(4), root, expected_previous=first)
    assert releases.current_release(spark, root) == second and releases.read_release(spark, root).count() == 4
    with pytest.raises(ValueError):
        releases.publish(inv(5), root, expected_previous=first)
    assert releases.current_release(spark, root) == second


def test_hysteresis_stream_over_disordered_files(spark, tmp_path):
    """Rows out of order across files, within the watermark's delay, all count."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=30 * i), i % 3 if i % 2 else 0, "view", float((i * 37) % 100), "") for i in range(120)]
    for n, part in enumerate((rows[:40] + rows[45:50], rows[40:45] + rows[50:90], rows[90:])):
        folder = tmp_path / "t" / "events.parquet"
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(folder))
    e = runs.events(spark, str(tmp_path / "t")).select("key", "ts", "at", "event_id", (F.col("value") * 6).alias("distance"))
    got = runs.run_to_end(state.folded(e, state.Membership()))
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").select(
        F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), "event_id", (F.col("value") * 6).alias("distance"))
    want = {(r.key, r.event_id): r.member for r in tm.hysteresis(batch).collect()}
    seen = {(r.key, r.event_id): r.member for r in got.collect()}
    assert len(seen) == 100 and all(want[k] == v for k, v in seen.items())


def answers(fold, rows):
    """What the fold says on rows (ms, candidate, score), frame by frame."""
    memory, out = None, []
    for start in sorted({r[0] * 1000 // fold.frame * fold.frame for r in rows}):
        held = [(r[0] * 1000, k, *r[1:]) for k, r in enumerate(rows) if r[0] * 1000 // fold.frame * fold.frame == start]
        memory, said = fold(memory, state.Frame(start, held[-1][1], held))
        out.append(said[0])
    return out


def test_choice_commits_keeps_and_clears():
    fold = state.Choice(100, 500, 1800)
    steady = [(t, "a", 10.0) for t in range(0, 700, 100)]
    assert answers(fold, steady) == [""] * 5 + ["a", "a"]
    better = steady + [(t, c, s) for t in range(700, 1400, 100) for c, s in (("a", 10.0), ("b", 12.0))]
    assert answers(fold, better)[-1] == "a"
    best = steady + [(t, c, s) for t in range(700, 1400, 100) for c, s in (("a", 10.0), ("b", 20.0))]
    assert answers(fold, best)[-1] == "b"
    assert answers(fold, steady + [(21_000, "c", 1.0)])[-1] == ""
    assert answers(fold, steady + [(1_500, "a", 1.0)])[-1] == "a"


def test_ranking_forgets_who_left_and_swaps_only_clear_winners():
    fold = state.Ranking(100)
    rows = [(0, "a", 10.0), (100, "a", 10.0), (100, "b", 11.0), (200, "a", 10.0), (200, "b", 13.0), (300, "c", 1.0), (900, "a", 5.0), (900, "c", 5.5)]
    assert answers(fold, rows) == ["a", "a|b", "b|a", "c", "c|a"]


def test_level_falls_rises_and_starts_anew():
    fold, memory, said = state.QualityLevel("high", block=10), None, []
    for k in range(3000):
        memory, out = fold(memory, state.Frame(k * 100_000, k, [(k * 100_000, k, 30.0 if k < 400 else 5.0)]))
        said += [out] if out else []
    assert said[0] == ("balanced", 1.0) and said[1] == ("smooth", 1.0) and said[-1][0] == "high"
    memory, out = fold(memory, state.Frame(10**12, 1, [(10**12, 1, 5.0)]))
    assert memory[0] == "high" and memory[3] == 1


def test_streams_forget_idle_keys_and_equal_the_fold(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=20 * i), i % 4, "abc"[i % 3], float((i * 37) % 100), "") for i in range(200)]
    for part in (rows[:70], rows[70:140], rows[140:]):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t" / "events.parquet"))
    for run, fold in ((runs.dwell_choice, state.Choice(runs.FRAME_MS, 2.5 * runs.FRAME_MS, 9 * runs.FRAME_MS)), (runs.stable_order, state.Ranking(runs.FRAME_MS))):
        got = {(r.key, r.event_id): r[2] for r in run(spark, str(tmp_path / "t")).collect()}
        assert len(got) > 100
        for user in range(4):
            memory = None
            own = [(int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), i, e, v) for i, ts, u, e, v, _ in rows if u == user]
            for start in sorted({r[0] // fold.frame for r in own}):
                held = [r for r in own if r[0] // fold.frame == start]
                memory, said = fold(memory, state.Frame(start * fold.frame, held[-1][1], held))
                if (user, held[-1][1]) in got:
                    assert got[user, held[-1][1]] == said[0]
