"""Roads in a view: how much of each line is seen, and which corridor is worth its bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.operators.raster import sample_dem
from landfold.plans.gridjoin import box_pairs, held
from landfold.session import cut_lineage

CLIP = ("x", "y", "z", "w")


def ground_steps(segments: DataFrame, dem: DataFrame, dem_step: float, rows: int, columns: int, step: float = 5.0, mode: str = "triangle") -> DataFrame:
    """(line_id, seq, idx, ax, ay, az, bx, by, bz): each segment in equal pieces of at most `step` metres, with ground heights at both ends.

    segments: line_id, seq, x1, z1, x2, z2. Pieces with an end off the known ground are left out. A sample is looked up
    once, though two pieces end there.
    """
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("z2") - F.col("z1")) * (F.col("z2") - F.col("z1")))
    n = F.greatest(F.lit(1), F.ceil(length / step).cast("int"))
    cut = segments.withColumn("n", n).select("line_id", "seq", "n", "x1", "z1", "x2", "z2", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("idx"))
    along = F.col("idx") / F.col("n")
    at = cut.select(F.struct("line_id", "seq", "idx").alias("pt_id"), (F.col("x1") + (F.col("x2") - F.col("x1")) * along).alias("x"), (F.col("z1") + (F.col("z2") - F.col("z1")) * along).alias("z"))
    known = at.join(sample_dem(at, dem, dem_step, rows, columns, mode, "y"), "pt_id").where("y is not null").select("pt_id.*", "x", "y", "z")
    ends = F.array(F.struct(F.col("idx").alias("piece"), F.lit(0).alias("end")), F.struct((F.col("idx") - 1).alias("piece"), F.lit(1).alias("end")))
    pairs = known.select("line_id", "seq", "x", "y", "z", F.inline(ends)).where("piece >= 0").groupBy("line_id", "seq", F.col("piece").alias("idx")).agg(
        F.count("*").alias("both"), *[F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{n}{c}") for e, n in enumerate("ab") for c in "xyz"])
    return pairs.where("both = 2").drop("both")


def _clip(col: str, half: float, aspect: float, near: float, far: float) -> dict[str, Column]:
    """Homogeneous clip coordinates of an end of a piece in its view; looking along f, without an offset of the view's centre."""
    d = {a: F.col(f"{col}{a}") - F.col(f"e{a}") for a in "xyz"}
    right, up, ahead = (sum((d[a] * F.col(f"{b}{a}") for a in "xyz"), F.lit(0.0)) for b in "ruf")
    return {"x": right / (half * aspect), "y": up / half, "z": (ahead * (far + near) - 2 * far * near) / (far - near), "w": ahead}


def seen_pieces(poses: DataFrame, pieces: DataFrame, height: float, aspect: float, fov_degrees: float, near: float = 0.5, far: float = 900.0) -> DataFrame:
    """The pieces in each view, clipped against its six planes: (pose_id, line_id, seq, idx, pixels, distance, score, sx, sz, tx, tz).

    poses: pose_id, ex..ez and the basis rx..rz, ux..uz, fx..fz. What is beyond the far plane cannot be seen, so views
    meet only the pieces within that reach on the grid.
    """
    half = math.tan(math.radians(fov_degrees) / 2)
    reach = far * math.sqrt(1 + half * half * (1 + aspect * aspect))
    views = poses.select("pose_id", *[f"{b}{a}" for b in "eruf" for a in "xyz"], *[(F.col(f"e{a}") + s * reach).alias(f"a{a}{i}") for a in "xz" for i, s in ((0, -1), (1, 1))])
    spans = pieces.select("*", *[f(f"a{a}", f"b{a}").alias(f"b{a}{i}") for a in "xz" for i, f in ((0, F.least), (1, F.greatest))])
    met = box_pairs(views, spans, base=64.0)
    a, b = (_clip(end, half, aspect, near, far) for end in "ab")
    met = held(met, {f"{end}_{c}": v for end, p in (("p", a), ("q", b)) for c, v in p.items()})
    planes = [(F.col(f"p_w") + s * F.col(f"p_{c}"), F.col(f"q_w") + s * F.col(f"q_{c}")) for c in "xyz" for s in (1, -1)]
    outside = F.lit(False)
    for p, q in planes:
        outside = outside | ((p < 0) & (q < 0))
    met = met.where(~outside)
    enter = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when((p < 0) & (q >= 0), p / (p - q)) for p, q in planes])
    leave = F.least(F.lit(1.0), F.lit(1.0), *[F.when((p >= 0) & (q < 0), p / (p - q)) for p, q in planes])
    met = held(met, {"enter": enter, "leave": leave}).where("enter <= leave")

    def between(x, y, t):
        return F.col(x) + (F.col(y) - F.col(x)) * F.col(t)

    met = held(met, {f"{n}_{c}": between(f"p_{c}", f"q_{c}", t) for n, t in (("s", "enter"), ("t", "leave")) for c in "xyw"}).where("s_w > 0 and t_w > 0")
    sx, sy, tx, ty = (F.col(f"{n}_{c}") / F.col(f"{n}_w") for n in "st" for c in "xy")
    across, down = (tx - sx) * (height * aspect / 2), (ty - sy) * (height / 2)
    cx, cy = (sx + tx) / 2, (sy + ty) / 2
    d = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    size = sum((v * v for v in d.values()), F.lit(0.0))
    t = F.coalesce(sum(((F.col(f"e{c}") - F.col(f"a{c}")) * d[c] for c in "xyz"), F.lit(0.0)) / F.nullif(size, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    gap = [F.col(f"a{c}") + d[c] * t - F.col(f"e{c}") for c in "xyz"]
    met = held(met, {"pixels": F.sqrt(across * across + down * down), "distance": F.sqrt(sum((v * v for v in gap), F.lit(0.0)))})
    central = F.lit(0.12) + F.lit(0.88) * F.exp(F.lit(-3.5) * (cx * cx + cy * cy))
    return met.select("pose_id", "line_id", "seq", "idx", "pixels", "distance", (F.col("pixels") * central / (F.lit(1.0) + F.col("distance") / 800)).alias("score"),
                      *[between(f"a{c}", f"b{c}", e).alias(f"{n}{c}") for n, e in (("s", "enter"), ("t", "leave")) for c in "xz"])


def _exact_sum(column: str) -> Column:
    """The sum of a column of moderate numbers, whatever the order of its rows; NaN if one of them is."""
    whole = F.sum(F.when(~F.isnan(column), F.col(column)).cast("decimal(28,18)")).cast("double")
    return F.when(F.max(F.isnan(column)), F.lit(float("nan"))).otherwise(whole)


def line_view_score(seen: DataFrame, min_pixels: float = 24.0) -> DataFrame:
    """(pose_id, line_id, score, pixels, distance) of the lines of which enough is seen, from seen_pieces().

    Sums do not depend on the order of pieces, so lines that look the same tie, and ranks go by line_id.
    """
    return seen.groupBy("pose_id", "line_id").agg(_exact_sum("score").alias("score"), _exact_sum("pixels").alias("pixels"), F.min("distance").alias("distance")).where(F.col("pixels") >= min_pixels)


def seen_partitions(seen: DataFrame, parts: DataFrame) -> DataFrame:
    """(pose_id, line_id, part_id) of a line's partitions whose plan box a seen piece of it crosses. parts: line_id, part_id, min_x, min_z, max_x, max_z."""
    j = seen.select("pose_id", "line_id", "sx", "sz", "tx", "tz").join(parts, "line_id")
    low, high, fits = F.lit(0.0), F.lit(1.0), F.lit(True)
    for c in "xz":
        start, delta, lo, hi = F.col(f"s{c}"), F.col(f"t{c}") - F.col(f"s{c}"), F.col(f"min_{c}"), F.col(f"max_{c}")
        flat = F.abs(delta) < 1e-10
        a, b = (lo - start) / F.nullif(delta, F.lit(0.0)), (hi - start) / F.nullif(delta, F.lit(0.0))
        fits = fits & F.when(flat, start.between(lo, hi)).otherwise(True)
        low = F.greatest(low, F.when(flat, F.lit(0.0)).otherwise(F.least(a, b)))
        high = F.least(high, F.when(flat, F.lit(1.0)).otherwise(F.greatest(a, b)))
    return j.where(fits & (low <= high)).select("pose_id", "line_id", "part_id").distinct()


def near_lines(scores: DataFrame, held: DataFrame | None = None, enter: float = 300.0, leave: float = 330.0) -> DataFrame:
    """Scored lines near enough to plan for; those held before (pose_id, line_id) stay up to the farther limit."""
    if held is None:
        return scores.where(F.col("distance") <= enter)
    kept = scores.join(held.select("pose_id", "line_id").distinct().withColumn("held", F.lit(True)), ["pose_id", "line_id"], "left")
    return kept.where(F.col("distance") <= F.when(F.col("held"), leave).otherwise(enter)).drop("held")


def corridor(lines: DataFrame, links: DataFrame, primary: DataFrame | None = None, hold: float = 1.2) -> DataFrame:
    """(pose_id, line_id, pos, first): the lines reached from each view's primary line over links, in the order in which they are reached.

    lines: pose_id, line_id, score; links: a, b. The primary is the line of the best score, unless the one before
    (primary: pose_id, line_id) is still there and hold times its score is no less. Lines are taken pass by pass, in each
    by rank; so a line's pass is the shortest way from the primary on which a step to a lower rank costs a pass. Rounds
    of minima per line settle all views at once, as many as the longest way has steps.
    """
    order = F.struct((-F.col("score")).alias("o"), "line_id")
    best = lines.groupBy("pose_id").agg(F.min(order).alias("top"), F.max("score").alias("most"))
    if primary is not None:
        old = primary.join(lines, ["pose_id", "line_id"]).select("pose_id", F.col("line_id").alias("old"), F.col("score").alias("old_score"))
        best = best.join(old, "pose_id", "left")
        chosen = F.when(F.col("old_score") * hold >= F.col("most"), F.col("old")).otherwise(F.col("top.line_id"))
    else:
        chosen = F.col("top.line_id")
    best = best.select("pose_id", chosen.alias("lead"))
    ranked = cut_lineage(lines.join(best, "pose_id").select("pose_id", "line_id", order.alias("rank"), (F.col("line_id") == F.col("lead")).alias("first")))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    here = ranked.select("pose_id", F.col("line_id").alias("a"), F.col("rank").alias("rank_a"), F.col("first").alias("first_a"))
    there = ranked.select("pose_id", F.col("line_id").alias("b"), F.col("rank").alias("rank_b"), F.col("first").alias("first_b"))
    steps = here.join(both, "a").join(there, ["pose_id", "b"]).where("not first_b")
    steps = cut_lineage(steps.select("pose_id", "a", "b", F.when((F.col("rank_a") < F.col("rank_b")) & ~F.col("first_a"), 0).otherwise(1).alias("cost")))
    reached = cut_lineage(ranked.where("first").select("pose_id", "line_id", F.lit(0).alias("turn")))
    edge = reached
    while not edge.isEmpty():
        via = edge.select("pose_id", F.col("line_id").alias("a"), "turn").join(steps, ["pose_id", "a"]).groupBy("pose_id", F.col("b").alias("line_id")).agg(F.min(F.col("turn") + F.col("cost")).alias("turn"))
        known = reached.select("pose_id", "line_id", F.col("turn").alias("before"))
        edge = cut_lineage(via.join(known, ["pose_id", "line_id"], "left").where("before is null or turn < before").select("pose_id", "line_id", "turn"))
        reached = cut_lineage(reached.unionByName(edge).groupBy("pose_id", "line_id").agg(F.min("turn").alias("turn")), replaces=reached)
    return reached.join(ranked, ["pose_id", "line_id"]).select("pose_id", "line_id", F.struct("turn", "rank").alias("pos"), "first")


def grow_corridor(found: DataFrame, links: DataFrame, parts: DataFrame, budgets: DataFrame, slots: int) -> DataFrame:
    """(pose_id, line_id, accepted, new_parts, paid) of each line of a corridor: the growth from its primary line under a budget.

    found: from corridor(); parts: pose_id, line_id, part_id, bytes of what is seen; budgets: pose_id, budget. A line is
    tried when a line linked with it has been accepted, in the order of the corridor, from where the last one was tried
    and around; each once. It is accepted if its partitions, less those already paid for, fit the budget and the slots
    and there is one at all. So a line behind one that was put off is not reached, though it would fit: accepted is
    false for both, and new_parts and paid are NULL where a line was never tried.

    One round tries one line of every view at once; what a view carries is its corridor, so rounds are as many as the
    longest has lines and no view is gathered into a task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    parts = cut_lineage(parts.select("pose_id", "line_id", "part_id", "bytes").join(found.select("pose_id", "line_id"), ["pose_id", "line_id"], "left_semi").dropDuplicates(["pose_id", "line_id", "part_id"]))
    waiting = cut_lineage(found.select("pose_id", "line_id", "pos", F.col("first").alias("open")))
    left = cut_lineage(budgets.join(found.select("pose_id").distinct(), "pose_id", "left_semi").select("pose_id", F.col("budget").cast("bigint").alias("left"), F.lit(slots).alias("slots"), F.lit(None).cast(found.schema["pos"].dataType).alias("last")))
    owned = parts.select("pose_id", "part_id").limit(0)
    tried = None
    while True:
        after = F.coalesce(F.col("pos") <= F.col("last"), F.lit(False))
        turn = waiting.where("open").join(left, "pose_id").groupBy("pose_id").agg(F.min_by(F.struct("line_id", "pos", "left", "slots"), F.struct(after, "pos")).alias("t")).select("pose_id", "t.*")
        price = parts.join(turn.select("pose_id", "line_id"), ["pose_id", "line_id"], "left_semi")
        seen = price.groupBy("pose_id").agg(F.count("*").alias("seen"))
        price = price.join(owned, ["pose_id", "part_id"], "left_anti").groupBy("pose_id").agg(F.count("*").alias("new_parts"), F.sum("bytes").alias("paid"))
        turn = turn.join(seen, "pose_id", "left").join(price, "pose_id", "left").fillna(0, ["seen", "new_parts", "paid"])
        fits = (F.col("seen") > 0) & (F.col("paid") <= F.col("left")) & (F.col("new_parts") <= F.col("slots"))
        turn = cut_lineage(turn.withColumn("accepted", fits))
        if turn.isEmpty():
            break
        tried = turn if tried is None else tried.unionByName(turn)
        won = turn.where("accepted")
        owned = cut_lineage(owned.unionByName(parts.join(won.select("pose_id", "line_id"), ["pose_id", "line_id"], "left_semi").select("pose_id", "part_id")).distinct())
        beside = won.select("pose_id", F.col("line_id").alias("a")).join(both, "a").select("pose_id", F.col("b").alias("line_id"), F.lit(True).alias("beside")).distinct()
        rest = waiting.join(turn.select("pose_id", "line_id"), ["pose_id", "line_id"], "left_anti").join(beside, ["pose_id", "line_id"], "left")
        waiting = cut_lineage(rest.select("pose_id", "line_id", "pos", (F.col("open") | F.col("beside").isNotNull()).alias("open")), replaces=waiting)
        spent = turn.select("pose_id", F.col("pos").alias("at"), *[F.when(F.col("accepted"), F.col(c)).otherwise(0).alias(n) for c, n in (("paid", "less"), ("new_parts", "fewer"))])
        left = cut_lineage(left.join(spent, "pose_id").select("pose_id", (F.col("left") - F.col("less")).alias("left"), (F.col("slots") - F.col("fewer")).cast("int").alias("slots"), F.col("at").alias("last")), replaces=left)
    if tried is None:
        return found.select("pose_id", "line_id", F.lit(False).alias("accepted"), F.lit(None).cast("bigint").alias("new_parts"), F.lit(None).cast("bigint").alias("paid"))
    done = tried.select("pose_id", "line_id", "accepted", "new_parts", "paid")
    return found.select("pose_id", "line_id").join(done, ["pose_id", "line_id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
