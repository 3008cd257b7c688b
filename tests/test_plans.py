"""The reusable plans against plain single-machine answers, with hot keys."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from landfold.plans import ordered
from landfold.plans.components import connected
from landfold.plans.greedy import greedy_budget
from landfold.plans.gridjoin import box_pairs, points_in_boxes


def skewed(spark, n=900):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rnd.randrange(400), rnd.choice([None, 1.0, 2.0, 5.0])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, id long, at long, v double")


def test_chunked_windows_equal_plain_ones(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("at", "id")
    plain = df.select("id", F.row_number().over(w).alias("rn"), F.lag("at").over(w).alias("prev"),
                      F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"),
                      F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    o = ["at", "id"]
    got = (ordered.numbered(df, ["k"], o).select("id", "rn")
           .join(ordered.lagged(df, ["k"], o, "at", "prev").select("id", "prev"), "id")
           .join(ordered.running(df, ["k"], o, {"s": ("sum", "v"), "l": ("last", "v")}).select("id", "s", "l"), "id")
           .join(ordered.running(df, ["k"], o, {"m": ("max", "v")}, exclusive=True).select("id", "m"), "id"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, plain.collect()), key=lambda r: r[0])
    desc = ordered.numbered(df, [], [F.col("at").desc(), "id"]).select("id", "rn")
    want = df.select("id", F.row_number().over(Window.orderBy(F.col("at").desc(), "id")).alias("rn"))
    assert sorted(map(tuple, desc.collect())) == sorted(map(tuple, want.collect()))


def test_tied_values_spread_over_chunks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        tied = spark.range(5000).selectExpr("'hot' as k", "7 as at", "id")
        assert ordered.with_chunks(tied, ["k"], ["at", "id"]).select("chunk").distinct().count() > 10
        got = ordered.numbered(tied, ["k"], ["at", "id"]).where("rn <> id + 1")
        assert got.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_quantiles_equal_numpy(spark):
    import numpy as np

    df = skewed(spark)
    got = {r.k: (r.a, r.b) for r in ordered.quantiles(df, ["k"], "at", [0.05, 0.5], ["a", "b"]).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.k, []).append(r["at"])
    for k, v in by.items():
        assert np.allclose(got[k], np.percentile(v, [5, 50]))


def test_components_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + hub + [(5000, 5000)], "u long, v long")
    nodes = spark.createDataFrame([(i,) for i in range(301)] + [(1000 + i,) for i in range(200)] + [(5000,), (6000,)], "id long")
    got = {r.id: r.component for r in connected(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5000] == 5000 and got[6000] == 6000


def brute(groups, items, budget, slots):
    out = {}
    for s in {g[0] for g in groups}:
        left, n, have = budget, 0, set()
        for g in sorted((g for g in groups if g[0] == s), key=lambda g: (-g[2], g[1])):
            if slots is not None and n >= slots:
                break
            fresh = [(i, z) for sc, gid, i, z in items if (sc, gid) == (s, g[1]) and i not in have] if items else [(g[1], g[3])]
            cost = sum(z for _, z in fresh)
            if cost <= left:
                left, n = left - cost, n + 1
                have |= {i for i, _ in fresh}
                out[(s, g[1])] = cost
    return out


def test_greedy_rounds_equal_the_walk(spark):
    rnd = random.Random(11)
    groups = [("hot" if i % 3 else "cold", i, rnd.randrange(40), rnd.randrange(1, 60)) for i in range(45)]
    items = [(g[0], g[1], it, 5 + it) for g in groups for it in sorted({rnd.randrange(25), rnd.randrange(25)})]
    gdf = spark.createDataFrame(groups, "scenario string, group_id long, score long, cost long")
    idf = spark.createDataFrame(items, "scenario string, group_id long, item_id long, size long")
    bdf = spark.createDataFrame([("hot", 90), ("cold", 90)], "scenario string, budget long")
    for its, df, slots in ((None, None, 5), (items, idf, None)):
        want = brute(groups, its, 90, slots)
        got = {(r.scenario, r.group_id): r.paid for r in greedy_budget(gdf, bdf, items=df, slots=slots).collect()}
        assert got == want


def test_greedy_keeps_fractions_and_skips_unknown_prices(spark):
    groups = spark.createDataFrame([("s", i, 9 - i, c) for i, c in enumerate([3.9, None, 3.9, 3.9, 2.2])], "scenario string, group_id long, score long, cost double")
    budget = spark.createDataFrame([("s", 10.0)], "scenario string, budget double")
    assert {r.group_id: r.paid for r in greedy_budget(groups, budget).collect()} == {0: 3.9, 2: 3.9, 4: 2.2}
    items = spark.createDataFrame([("s", 0, 1, 2.5), ("s", 0, 1, 4.0), ("s", 1, 2, None), ("s", 2, 1, 2.5), ("s", 3, 3, 7.0), ("s", 4, 4, 0.5)], "scenario string, group_id long, item_id long, size double")
    assert {r.group_id: r.paid for r in greedy_budget(groups, budget, items=items).collect()} == {0: 4.0, 2: 0.0, 4: 0.5}


def test_greedy_on_a_million_rows(spark):
    groups = spark.range(1_000_000).selectExpr("'hot' as scenario", "id as group_id", "id % 1000 as score", "cast(1 + (id * 7919) % 997 as double) / 8 as cost")
    budget = spark.createDataFrame([("hot", 40.0)], "scenario string, budget double")
    left, want = 40.0, {}
    for i in sorted(range(1_000_000), key=lambda i: (-(i % 1000), i))[:5000]:
        cost = (1 + (i * 7919) % 997) / 8
        if len(want) < 3 and cost <= left:
            left, want[i] = left - cost, cost
    assert {r.group_id: r.paid for r in greedy_budget(groups, budget, slots=3).collect()} == want


def test_nearest_of_type_in_a_deep_chain_and_on_a_cycle(spark):
    from landfold.operators.hierarchy import nearest_of_type

    rows = [(f"e{i}", f"e{i - 1}" if i else None, "root" if i == 0 else "mid" if i == 700 else "leaf") for i in range(1500)] + [("a", "b", "mid"), ("b", "c", "leaf"), ("c", "a", "leaf"), ("d", "c", "leaf"), ("x", "gone", "mid")]
    got = {r.entity_id: (r.root, r.mid) for r in nearest_of_type(spark.createDataFrame(rows, "entity_id string, parent_id string, type string"), "root", "mid").collect()}
    assert all(got[f"e{i}"] == ("e0", "e700" if i >= 700 else None) for i in range(1500))
    assert got["b"] == got["c"] == got["d"] == (None, "a") and got["x"] == (None, "x")


def test_mask_union_and_tiles_left_of_zero(spark):
    from landfold.operators import raster

    cells = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("b", 2, 5000)], "mask_id string, row_no long, col_no long")
    masks = spark.createDataFrame([("a", -8.0, 0.0, 2.0), ("b", 0.0, 4.0, 1.0)], "mask_id string, min_x double, min_z double, step double")
    assert {tuple(r) for r in raster.mask_or(cells, masks).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (4, 8), (6, 5008)}
    grid = raster.tile_grid(spark.createDataFrame([(-1, -3, 1.0), (0, 0, 1.0), (-30, 4, 1.0)], "row_no long, col_no long, h double"), n=10)
    assert grid.where("core").count() == 3


def test_grid_joins_equal_brute_force(spark):
    rnd = random.Random(5)
    box = lambda: (lambda x, z, s, t: (x, z, x + s, z + t))(rnd.uniform(-300, 300), rnd.uniform(-300, 300), rnd.choice([1, 7, 90, 400]), rnd.choice([2, 30, 250]))
    a, b = [(i, *box()) for i in range(60)], [(i, *box()) for i in range(60)]
    adf = spark.createDataFrame(a, "a long, ax0 double, az0 double, ax1 double, az1 double")
    bdf = spark.createDataFrame(b, "b long, bx0 double, bz0 double, bx1 double, bz1 double")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted((r.a, r.b) for r in box_pairs(adf, bdf).collect()) == want
    pts = [(i, rnd.uniform(-300, 300), rnd.uniform(-300, 300)) for i in range(200)]
    pdf = spark.createDataFrame(pts, "p long, x double, z double")
    want = sorted((p[0], q[0]) for p in pts for q in b if q[1] <= p[1] <= q[3] and q[2] <= p[2] <= q[4])
    assert sorted((r.p, r.b) for r in points_in_boxes(pdf, bdf).collect()) == want


BOXES = ("x0", "z0", "x1", "z1")


def price(spent, boxes, current, slots):
    """Bytes of a set with its union mask, None if that may not be built."""
    boxes = [b for b in boxes if b[0] is not None]
    if len(boxes) > slots:
        return None
    wide, high = (max(b[k + 2] for b in boxes) - min(b[k] for b in boxes) for k in (0, 1)) if boxes else (1, 1)
    return None if max(wide, high) > 4096 else spent + wide * high + max(wide * high, current)


def brute_tiers(rows, budget, current, slots):
    """The four passes over the ranked list, one group at a time."""
    by = sorted(rows, key=lambda r: (-r[1], r[0]))
    chosen: dict[int, tuple[str, int, tuple]] = {}

    def fits(g, level, cost, box):
        trial = {**chosen, g: (level, cost, box)}
        total = price(sum(c for _, c, _ in trial.values()), [b for *_, b in trial.values()], current, slots)
        return total is not None and total <= budget

    def take(g, level, cost, box):
        if ok := fits(g, level, cost, box):
            chosen[g] = (level, cost, box)
        return ok

    for g, _, prot, near, fine, hc, fc, *box in by:
        if prot:
            take(g, "fine", fc, box)
    kept = set(chosen)
    for g, _, prot, near, fine, hc, fc, *box in by:
        if near and g not in chosen:
            take(g, "high", hc, box)
    for g, _, prot, near, fine, hc, fc, *box in by:
        if g in chosen and g not in kept and fine:
            take(g, "fine", fc, box)
    unmet = any(near and g not in kept and (g not in chosen or fine and chosen[g][0] != "fine") for g, _, _, near, fine, *_ in rows)
    reserved = set(chosen)
    for g, _, prot, near, fine, hc, fc, *box in by:
        if g not in reserved and not (fine and not (not near and unmet) and take(g, "fine", fc, box)):
            take(g, "high", hc, box)
    return {g: (level, cost) for g, (level, cost, _) in chosen.items()}


def test_tiers_equal_the_walk(spark):
    from landfold.operators.selection import tiered_budget

    rnd = random.Random(2)
    cols = "scenario string, group_id long, score long, protected boolean, near boolean, wants_fine boolean, high_cost long, fine_cost long, x0 long, z0 long, x1 long, z1 long"
    sets = {}
    for k, share in enumerate((0.15, 0.6, 0.3, 0.3)):
        rows = []
        for i in range(26):
            x, z = rnd.randrange(12), rnd.randrange(9)
            box = (x, z, x + rnd.randrange(1, 5), z + rnd.randrange(1, 5)) if rnd.random() < 0.8 else (None,) * 4
            if k == 3 and i == 5:
                box = (0, 0, 5000, 1)  # too wide for one mask
            rows.append((i, rnd.randrange(50), rnd.random() < 0.1, rnd.random() < share, rnd.random() < 0.6, h := rnd.randrange(1, 30), h + rnd.randrange(1, 40), *box))
        sets[f"s{k}"] = rows
    df = spark.createDataFrame([(s, *r) for s, rows in sets.items() for r in rows], cols)
    b = spark.createDataFrame([(s, 500) for s in sets], "scenario string, budget long").withColumn("current", F.lit(40))
    got = tiered_budget(df, b, 9).collect()
    for s, rows in sets.items():
        assert {r.group_id: (r.level, r.paid) for r in got if r.scenario == s} == brute_tiers(rows, 500, 40, 9), s
