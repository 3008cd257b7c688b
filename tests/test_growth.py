"""What a query's steps must not do as tables grow."""

import math
import random

from landfold import catalogue
from landfold.operators import bodies, hierarchy, linkage
from landfold.plans import boxtree

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clearance_of_more_than_a_million_faces(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").where("p_partkey < 12")
    part.unionByName(part.withColumn("p_partkey", part.p_partkey + 1000000)).write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.spark_queries()["d30_clearance"](spark, str(tmp_path)).collect()
    assert sum(r.samples for r in got) == 48


def test_clearance_does_not_meet_all_that_wide_components_cover(spark, monkeypatch):
    rng, faces = random.Random(7), []
    put = lambda c, x, y, z: faces.append((c, 0, len(faces), x, y, z, x + 2, y + 0.5, z, x, y, z + 2))
    for i in range(24):
        for j in range(24):
            put(len(faces), i * 24.0 - 300, float(rng.choice((0, 5, 60))), j * 24.0 - 300)
    # across the whole field: among the others, between them, just above them, too far above, and along one edge only
    for k, (low, high, wide) in enumerate([(0.0, 60.0, 560.0)] * 12 + [(20.0, 40.0, 560.0)] * 12 + [(72.0, 80.0, 560.0)] * 12 + [(95.0, 99.0, 560.0)] * 12 + [(20.25, 30.0, 0.0)] * 12):
        put(10000 + k, -310.0, low + k % 12 / 8, -310.0)
        put(10000 + k, -310.0 + wide, high + k % 12 / 8, 250.0)
    met, opened = [], []
    monkeypatch.setattr(bodies, "box_pairs", lambda *a, go=bodies.box_pairs, **kw: met.append((out := go(*a, **kw)).count()) or out)
    monkeypatch.setattr(boxtree, "cut_lineage", lambda df, go=boxtree.cut_lineage, **kw: opened.append((out := go(df, **kw)).count()) or out)
    tri = spark.createDataFrame(faces, "component bigint, tile_id int, tri_idx bigint, " + ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xyz"))
    got = {r.component: r.separation for r in bodies.clearance(tri, 30.0).collect()}
    part = [(f[0], tuple((min(f[3 + a::3]), max(f[3 + a::3])) for a in range(3))) for f in faces]
    box = {}
    for c, b in part:
        box[c] = tuple((min(p[0], q[0]), max(p[1], q[1])) for p, q in zip(box.get(c, b), b))
    gap = lambda p, q: math.sqrt(sum(max(0.0, v[0] - u[1], u[0] - v[1]) ** 2 for u, v in zip(p, q)))
    want = {c: min((d for o, q in part if o != c and (d := gap(p, q)) <= 30), default=None) for c, p in box.items()}
    assert got == want
    assert sum(met) + sum(opened) < 25 * len(faces)


def test_view_score_shuffles_no_corners(spark):
    assert "Aggregate [pose_id" not in plan(catalogue.spark_queries()["t8_view_score"](spark, DATA))


def test_resolve_index_joins_nothing(spark):
    doc = spark.sql("SELECT 'a' AS doc_id, array(1, 0, 7, -1, NULL) AS materials, array(1, 5) AS textures, array('p', NULL) AS images UNION ALL SELECT 'b', array(0), array(0), NULL")
    out = linkage.resolve_index(doc)
    assert [tuple(r) for r in out.collect()] == [("a", 1, 0, 1, None)]
    assert "Join" not in plan(out)


def test_related_resources_compares_only_shared_ones(spark):
    places = spark.createDataFrame([("room", "floor", "house"), ("floor", "floor", "house"), ("house", None, "house")], "entity_id string, floor string, building string")
    bound = spark.createDataFrame([("floor", 1, "x"), ("house", 1, "x"), ("house", 1, "y"), ("house", 2, None), ("house", 2, None), ("room", 2, None)], "target_id string, resource_id int, relation string")
    out = linkage.related_resources(places, bound)
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    assert got == sorted(str((e, i, k)) for e in ("room", "floor", "house") for i, k in ((1, "x"), (1, "y"), (2, None)))
    assert "Aggregate" not in plan(out).split("Union")[0]


def test_leaves_are_not_walked(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(hierarchy, "descend", lambda roots, children, step, go=hierarchy.descend: walked.append(children.count()) or go(roots, children, step))
    rows = [("top", None), ("lost", "gone"), ("a", "top"), *[(f"leaf{i}", "a") for i in range(20)], ("x", "y"), ("y", "x"), ("below", "y"), ("twice", "y"), ("twice", "a"), ("both", "x"), ("both", "y")]
    entities = spark.createDataFrame(rows, "entity_id string, parent_id string")
    relations = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "x")], "source_id string, target_id string")
    got = sorted((r.rule, r.key or "") for r in hierarchy.hierarchy_violations(entities, relations).collect())
    assert got == [("dangling-parent", "lost"), ("duplicate-id", "both"), ("duplicate-id", "twice"), *[("parent-cycle", k) for k in ("below", "both", "both", "x", "y")],
                   ("relation-source_id", ""), ("relation-target_id", "b"), ("relation-target_id", "b")]
    assert max(walked) <= 3


def test_ancestors_of_leaves_come_from_their_parents(spark, monkeypatch):
    written = []
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df, cut=hierarchy.cut_lineage, **kw: written.append(cut(df, **kw)) or written[-1])
    rows = [("top", None), ("lost", "gone"), ("a", "top"), *[(f"leaf{i}", "a") for i in range(20)], ("x", "y"), ("y", "x"), ("below", "y"), ("self", "self"), (None, "a")]
    entities = spark.createDataFrame(rows, "entity_id string, parent_id string")
    got = hierarchy.ancestors(entities)
    told = sorted(map(str, map(tuple, got.collect())))
    assert max(df.count() for df in written) < 20
    assert told == sorted(map(str, map(tuple, hierarchy._climb(entities, entities).collect())))
    twice = entities.unionByName(spark.createDataFrame([("leaf1", "top")], entities.schema))
    assert sorted(map(str, map(tuple, hierarchy.ancestors(twice).collect()))) == sorted(map(str, map(tuple, hierarchy._climb(twice, twice).collect())))


def test_paths_of_leaves_come_from_their_parents(spark, monkeypatch):
    written = []
    monkeypatch.setattr(hierarchy, "descend", lambda roots, children, step, go=hierarchy.descend: written.append(children.count()) or go(roots, children, step))
    rows = [("top", None, "campus"), ("lost", "gone", "zone"), ("a", "top", "zone"), *[(f"leaf{i}", "a", "space") for i in range(20)], ("x", "y", "zone"), ("y", "x", "zone"), ("below", "y", "space"), (None, "a", "space")]
    entities = spark.createDataFrame([(e, p, t, f"N{e}") for e, p, t in rows], "entity_id string, parent_id string, type string, name string")
    got = {r.entity_id: r.description for r in hierarchy.describe_paths(entities).collect()}
    assert got == {"top": "campus", "lost": "zone", "a": "zone · Ntop", **{f"leaf{i}": "space · Na" for i in range(20)}, "x": "zone", "y": "zone", "below": "space", None: "space"}
    assert max(written) <= 4


def test_given_depths_are_not_walked_for(spark, monkeypatch):
    walks = []
    monkeypatch.setattr(hierarchy, "descend", lambda *a, go=hierarchy.descend: walks.append(1) or go(*a))
    nodes = spark.createDataFrame([(0, None, True, 8.0, 0), (1, 0, True, 1.0, 1), (2, 0, True, 1.0, 1)], "node_id long, parent_id long, available boolean, error double, depth int")
    assert sorted(r.node_id for r in hierarchy.frontier(nodes, 1.0).collect()) == [1, 2]
    assert len(walks) == 1
