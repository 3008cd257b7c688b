"""Greedy whole-group budgets as a few set-based rounds.

The rule walks groups by rank, takes each one that still fits and skips the
others. A round decides many groups at once and decides them exactly:

* the marginal cost of a group, were every earlier candidate taken, is the size
  of the items it is the first candidate to need;
* that is also the least it can ever cost, so a group for which it exceeds what
  is left is skipped for good;
* all candidates before the first that does not fit are taken, since for them
  the assumption holds;
* with shared items, nothing changes before the next group that fits at its price of now: all before it are skipped
  for good, and without slots all whose items are owned are taken at once, so rounds are at most the items bought;
* that first misfit is settled too: its exact price and what is left at its turn
  are known. It is skipped, or taken at its fallback price if it has one that fits.

Each round settles at least one group per scenario and usually most of them.
With a number of slots and no shared items, as many rounds each take the first group that
still fits. Running sums go by chunks of the score, so a scenario may hold any share of rows,
and the same rounds serve every size. Prices and budgets keep their types; a group
whose price is not known, since its cost or the size of an item is NULL, is not taken.
An item given with two sizes has the larger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.plans.ordered import running
from landfold.session import cut_lineage


def _by_slots(groups: DataFrame, left: DataFrame, slots: int) -> DataFrame:
    """At most so many groups: each round takes the first group after the last one that fits, one combinable minimum per scenario."""
    taken = []
    left = left.withColumn("last", F.lit(None).cast("struct<ord: double, group_id: bigint>"))
    for _ in range(slots):
        at = F.struct("ord", F.col("group_id").cast("bigint").alias("group_id"))
        paid = F.when(F.col("cost") <= F.col("remaining"), F.col("cost")).when(F.col("fallback") <= F.col("remaining"), F.col("fallback"))
        open_ = groups.join(left, "scenario").where(F.col("last").isNull() | (at > F.col("last"))).withColumns({"paid": paid, "at": at}).where("paid is not null")
        first = open_.groupBy("scenario").agg(F.min_by(F.struct("group_id", "paid", "remaining", "at"), "at").alias("f")).select("scenario", "f.*")
        first = cut_lineage(first)
        if first.isEmpty():
            break
        taken.append(first.select("scenario", "group_id", "paid"))
        left = first.select("scenario", (F.col("remaining") - F.col("paid")).alias("remaining"), F.col("at").alias("last"))
    return reduce(DataFrame.unionByName, taken) if taken else groups.limit(0).select("scenario", "group_id", F.col("cost").alias("paid"))


def greedy_budget(groups: DataFrame, budgets: DataFrame, items: DataFrame | None = None, slots: int | None = None) -> DataFrame:
    """(scenario, group_id, paid) of the groups taken.

    groups: scenario, group_id, score and, without items, cost and optionally fallback,
    a lower price to try at the same turn; budgets: scenario, budget; items: scenario,
    group_id, item_id, size — an item already taken is free.
    """
    groups = groups.dropDuplicates(["scenario", "group_id"]).withColumn("ord", -F.col("score").cast("double"))
    if items is None:
        groups = groups.where("cost is not null")
        if "fallback" not in groups.columns:
            groups = groups.withColumn("fallback", F.lit(None).cast("bigint"))
    else:
        sizes = items.groupBy("scenario", "item_id").agg(F.max("size").alias("size"))
        items = cut_lineage(items.select("scenario", "group_id", "item_id").distinct().join(sizes, ["scenario", "item_id"]))
        groups = groups.join(items.where("size is null").select("scenario", "group_id").distinct(), ["scenario", "group_id"], "left_anti")
    todo = cut_lineage(groups)
    if slots is not None and items is None:
        return _by_slots(todo, budgets.select("scenario", F.col("budget").alias("remaining")), slots)
    left = cut_lineage(budgets.select("scenario", F.col("budget").alias("remaining"), F.lit(slots).cast("bigint").alias("slots")))
    owned = None
    taken: list[DataFrame] = []
    while True:
        if items is None:
            priced = todo.withColumn("low", F.coalesce(F.least("cost", "fallback"), "cost"))
        else:
            needed = items if owned is None else items.join(owned, ["scenario", "item_id"], "left_anti")
            now = needed.groupBy("scenario", "group_id").agg(F.sum("size").alias("now"))
            now = todo.join(now, ["scenario", "group_id"], "left").withColumn("now", F.coalesce("now", F.lit(0)))
            now = cut_lineage(now.join(left.select("scenario", "remaining"), "scenario"))
            pays = F.coalesce(F.col("now") <= F.col("remaining"), F.lit(True))
            if slots is None:
                taken.append(now.where((F.col("now") == 0) & pays).select("scenario", "group_id", F.col("now").alias("paid")))
                now = now.where((F.col("now") != 0) | ~pays)
            start = now.where(pays).groupBy("scenario").agg(F.min(F.struct("ord", "group_id")).alias("start"))
            todo = cut_lineage(now.join(start, "scenario").where(F.struct("ord", "group_id") >= F.col("start")).select(*todo.columns), replaces=todo)
            open_items = needed.join(todo.select("scenario", "group_id", "ord"), ["scenario", "group_id"])
            payer = open_items.groupBy("scenario", "item_id").agg(F.min_by("group_id", F.struct("ord", "group_id")).alias("group_id"), F.max("size").alias("size"))
            price = payer.groupBy("scenario", "group_id").agg(F.sum("size").alias("cost"))
            priced = todo.drop("cost").join(price, ["scenario", "group_id"], "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
            priced = priced.withColumn("low", F.col("cost"))
        priced = priced.withColumn("one", F.lit(1).cast("bigint"))
        summed = running(priced, ["scenario"], ["ord", "group_id"], {"spent": ("sum", "cost"), "count": ("sum", "one")})
        summed = summed.join(left, "scenario")
        over_slots = F.coalesce(F.col("count") > F.col("slots"), F.lit(False))
        state = cut_lineage(summed.withColumns({"hopeless": F.col("low") > F.col("remaining"), "stop": (F.col("spent") > F.col("remaining")) | over_slots | (F.col("cost") > F.col("remaining"))}))
        first = state.where("stop").groupBy("scenario").agg(F.min(F.struct("ord", "group_id")).alias("first"))
        judged = state.join(first, "scenario", "left").withColumn("fits", F.col("first").isNull() | (F.struct("ord", "group_id") < F.col("first")))
        turn = F.col("remaining") - (F.col("spent") - F.col("cost"))
        lowered = judged.where("struct(ord, group_id) = first").where((F.col("low") <= turn) & ~F.coalesce(F.col("count") > F.col("slots"), F.lit(False)))
        win = judged.where("fits").withColumn("paid", F.col("cost")).unionByName(lowered.withColumn("paid", F.col("low")))
        taken.append(win.select("scenario", "group_id", "paid"))
        used = win.groupBy("scenario").agg(F.sum("paid").alias("used"), F.count("*").alias("n"))
        left = cut_lineage(left.join(used, "scenario", "left").select(
            "scenario", (F.col("remaining") - F.coalesce("used", F.lit(0))).alias("remaining"), (F.col("slots") - F.coalesce("n", F.lit(0))).alias("slots")), replaces=left)
        if items is not None:
            new = cut_lineage(items.join(win.select("scenario", "group_id"), ["scenario", "group_id"], "left_semi").select("scenario", "item_id").distinct())
            owned = new if owned is None else cut_lineage(owned.unionByName(new))
        rest = judged.where("not fits and not hopeless and struct(ord, group_id) <> first").select(*todo.columns)
        rest = rest.join(left.where("slots is null or slots > 0").select("scenario"), "scenario", "left_semi")
        todo = cut_lineage(rest, replaces=todo)
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, taken)


BOX = ("x0", "z0", "x1", "z1")
WIDEST, MOST_CELLS = 4096, 16 << 20


def boxed_price(spent: Column, box: list[Column], masks: Column, current: Column, slots: int) -> Column:
    """Bytes of a set of groups with the one mask that covers all of theirs; NULL if that mask may not be built.

    The mask is the box of all masks, a byte a cell of the common lattice (1 without any), and stands twice while it is
    built anew: once more its size, or that of the one in use if that is larger.
    """
    wide, high = box[2] - box[0], box[3] - box[1]
    cells = F.when(F.coalesce(masks, F.lit(0)) == 0, F.lit(1)).when((masks <= slots) & (wide <= WIDEST) & (high <= WIDEST) & (wide * high <= MOST_CELLS), wide * high)
    return spent + cells + F.greatest(cells, current)


def greedy_boxed(groups: DataFrame, state: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """(scenario, group_id, paid) of the groups taken by rank, and the state after them, when all masks share one union.

    groups: scenario, group_id, score, cost, optionally fallback (a lower cost to try at the same turn), and the mask's
    box x0, z0, x1, z1 in whole cells, NULL for none; state: scenario, budget, current, spent, masks and the box so far.
    The price of a set grows with the set: so a group that does not fit beside what is taken now never will, and of the
    others all before the first that does not fit beside all earlier ones are taken. That first one's price at its turn
    is then known too. Rounds and their cost are as for greedy_budget().
    """
    if "fallback" not in groups.columns:
        groups = groups.withColumn("fallback", F.lit(None).cast("bigint"))
    todo = cut_lineage(groups.where("cost is not null").dropDuplicates(["scenario", "group_id"]).select(
        "scenario", "group_id", (-F.col("score").cast("double")).alias("ord"), F.col("cost").cast("bigint").alias("cost"), F.col("fallback").cast("bigint").alias("fallback"), *BOX))
    taken = []

    def hull(sign, a, b):
        return (F.least if sign < 0 else F.greatest)(a, b)  # both skip NULLs

    sides = list(zip(BOX, (-1, -1, 1, 1)))
    while not todo.isEmpty():
        held = state.select("scenario", "budget", "current", F.col("spent").alias("had"), F.col("masks").alias("had_masks"), *[F.col(c).alias(f"had_{c}") for c in BOX])
        marked = todo.withColumns({"one": F.when(F.col("x0").isNotNull(), 1).otherwise(0).cast("bigint"), **{f"m_{c}": F.col(c) * s for c, s in sides}})
        summed = running(marked, ["scenario"], ["ord", "group_id"], {"sum": ("sum", "cost"), "ones": ("sum", "one"), **{f"r_{c}": ("max", f"m_{c}") for c in BOX}}).join(held, "scenario")
        upto = [hull(s, F.col(f"had_{c}"), F.col(f"r_{c}") * s) for c, s in sides]
        beside = [hull(s, F.col(f"had_{c}"), F.col(c)) for c, s in sides]
        low = F.least("cost", "fallback")
        price = boxed_price(F.col("had") + F.col("sum"), upto, F.col("had_masks") + F.col("ones"), F.col("current"), slots)
        alone = boxed_price(F.col("had") + low, beside, F.col("had_masks") + F.col("one"), F.col("current"), slots)
        fits = lambda p: F.coalesce(p <= F.col("budget"), F.lit(False))
        judged = cut_lineage(summed.withColumns({"stop": ~fits(price), "hopeless": ~fits(alone), "lowered": fits(price - F.col("cost") + low), "low": low}).select(*todo.columns, "one", "stop", "hopeless", "lowered", "low"))
        at = F.struct("ord", "group_id")
        first = judged.where("stop").groupBy("scenario").agg(F.min(at).alias("first"))
        judged = judged.join(first, "scenario", "left").withColumn("before", F.col("first").isNull() | (at < F.col("first")))
        win = judged.where("before").withColumn("paid", F.col("cost")).unionByName(judged.where((at == F.col("first")) & F.col("lowered")).withColumn("paid", F.col("low")))
        win = cut_lineage(win.select("scenario", "group_id", "paid", "one", *BOX))
        taken.append(win.select("scenario", "group_id", "paid"))
        more = win.groupBy("scenario").agg(F.sum("paid").alias("more"), F.sum("one").alias("ones"), *[(F.min if s < 0 else F.max)(c).alias(f"w_{c}") for c, s in sides])
        state = cut_lineage(state.join(more, "scenario", "left").select(
            "scenario", "budget", "current", (F.col("spent") + F.coalesce("more", F.lit(0))).alias("spent"), (F.col("masks") + F.coalesce("ones", F.lit(0))).alias("masks"), *[hull(s, F.col(c), F.col(f"w_{c}")).alias(c) for c, s in sides]))
        todo = cut_lineage(judged.where(~F.col("before") & ~F.col("hopeless") & (at != F.col("first"))).select(*todo.columns), replaces=todo)
    return (reduce(DataFrame.unionByName, taken) if taken else todo.select("scenario", "group_id", F.col("cost").alias("paid"))), state
