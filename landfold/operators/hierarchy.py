"""Entity trees, level-of-detail frontiers and graph checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.plans.levels import descend
from landfold.session import cut_lineage


def _split(entities: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The entities that others hang from, and those that none does; None where an id occurs twice. A row without an id hangs from nothing."""
    named = entities.where("parent_id is not null").select(F.col("parent_id").alias("entity_id")).distinct().withColumn("known", F.lit(True))
    tally = entities.groupBy("entity_id").agg(F.count("*").alias("n"))
    marked = cut_lineage(tally.join(named, "entity_id", "left").where("known or n > 1"))
    if not marked.where("n > 1").isEmpty():
        return None
    known = marked.select("entity_id")
    hung = entities.withColumn("parent_id", F.when(F.col("entity_id").isNotNull(), F.col("parent_id")))
    return cut_lineage(hung.join(known, "entity_id", "left_semi")), hung.join(known, "entity_id", "left_anti")


def ancestors(entities: DataFrame) -> DataFrame:
    """(entity_id, ancestor_id, depth) for every ancestor, self at depth 0; stops on a repeated id.

    From the tops down, one join per level carries the way so far, which is as long as the answer. Only ids that something
    hangs from are walked, the others take the way of their parent. What no top reaches, and everything if an id occurs
    twice, climbs instead: one join per level, with the ids seen.
    """
    entities = entities.select("entity_id", "parent_id")
    split = _split(entities)
    if split is None:
        return _climb(entities, entities)
    inner, leaves = split
    known = inner.select(F.col("entity_id").alias("parent_id"))
    none = F.array().cast(f"array<{dict(entities.dtypes)['entity_id']}>")

    def way(level):
        return level.select(F.col("entity_id").alias("parent_id"), F.array_prepend("above", F.col("entity_id")).alias("above"))

    tops = inner.join(known, "parent_id", "left_anti").select("entity_id", none.alias("above"))
    ways = descend(tops, inner, lambda level, children: children.join(way(level), "parent_id").select("entity_id", "above"))
    stuck = cut_lineage(inner.join(ways.select("entity_id"), "entity_id", "left_anti"))
    climbing = None
    if not stuck.isEmpty():
        cyclic = stuck.select(F.col("entity_id").alias("parent_id"))
        climbing = _climb(stuck.unionByName(leaves.join(cyclic, "parent_id", "left_semi").select("entity_id", "parent_id")), entities)
        leaves = leaves.join(cyclic, "parent_id", "left_anti")
    below = leaves.join(way(ways), "parent_id", "left").select("entity_id", F.coalesce("above", none).alias("above"))
    told = ways.unionByName(below).select("entity_id", F.posexplode(F.array_prepend("above", F.col("entity_id"))).alias("depth", "ancestor_id")).select("entity_id", "ancestor_id", "depth")
    return told if climbing is None else told.unionByName(climbing)


def _climb(some: DataFrame, entities: DataFrame) -> DataFrame:
    """ancestors() of some entities, one join per level, with the ids seen on the way."""
    parents = entities.where("parent_id is not null").select(F.col("entity_id").alias("ancestor_id"), F.col("parent_id"))
    known = entities.select(F.col("entity_id").alias("parent_id"))
    parents = parents.join(known, "parent_id", "left_semi")
    level = cut_lineage(some.select("entity_id", F.col("entity_id").alias("ancestor_id"), F.lit(0).alias("depth"), F.array("entity_id").alias("seen")))
    levels = [level.drop("seen")]
    while not level.isEmpty():
        level = cut_lineage(level.join(parents, "ancestor_id").where(~F.array_contains("seen", F.col("parent_id"))).select(
            "entity_id", F.col("parent_id").alias("ancestor_id"), (F.col("depth") + 1).alias("depth"),
            F.array_append("seen", F.col("parent_id")).alias("seen"),
        ))
        levels.append(level.drop("seen"))
    return reduce(DataFrame.unionByName, levels)


def nearest_of_type(entities: DataFrame, *types: str, chain: DataFrame | None = None) -> DataFrame:
    """Nearest ancestor of each type, self included: one column per type, NULL if none.

    By doubling: every entity knows the nearest of each type on the way to the entity it points at, and takes over what
    that one knows and points at, so the rounds are the logarithm of the depth. On a cycle they end once every way has
    been gone round.
    """
    if chain is None:
        known = entities.select(F.col("entity_id").alias("parent_id")).distinct()
        above = entities.join(known, "parent_id", "left_semi").select("entity_id", F.col("parent_id").alias("above"))
        near = {t: F.when(F.col("type") == t, F.col("entity_id")) for t in types}
        now = cut_lineage(entities.select("entity_id", *[c.alias(t) for t, c in near.items()]).join(above, "entity_id", "left"))
        for _ in range(now.count().bit_length() + 1):
            if now.where("above is not null").isEmpty():
                break
            ahead = now.select(F.col("entity_id").alias("above"), F.col("above").alias("further"), *[F.col(f"`{t}`").alias(f"next_{t}") for t in types])
            now = cut_lineage(now.join(ahead, "above", "left").select("entity_id", *[F.coalesce(F.col(f"`{t}`"), F.col(f"`next_{t}`")).alias(t) for t in types], F.col("further").alias("above")), replaces=now)
        return now.drop("above")
    typed = chain.join(entities.select(F.col("entity_id").alias("ancestor_id"), "type"), "ancestor_id")
    return typed.groupBy("entity_id").agg(*[
        F.min_by(F.when(F.col("type") == t, F.col("ancestor_id")), F.when(F.col("type") == t, F.col("depth"))).alias(t) for t in types
    ])


def zone_members(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Children of zones and targets of their `contains` relations, without the zone itself."""
    zones = entities.where("type = 'zone'").select(F.col("entity_id").alias("zone_id"))
    children = entities.select(F.col("parent_id").alias("zone_id"), F.col("entity_id").alias("member_id"))
    named = relations.where("type = 'contains'").select(F.col("source_id").alias("zone_id"), F.col("target_id").alias("member_id"))
    named = named.join(entities.select(F.col("entity_id").alias("member_id")), "member_id", "left_semi").select("zone_id", "member_id")
    return children.unionByName(named).where("zone_id <> member_id").join(zones, "zone_id", "left_semi").distinct()


def describe_paths(entities: DataFrame) -> DataFrame:
    """(entity_id, description): type and ancestor names from the root down, without the campus unless it is the only one.

    From the tops down, each level one join that carries the path so far, which is as long as the answer. Only ids that
    something hangs from are walked, unless an id occurs twice; the others take the path of their parent. An entity on or
    below a cycle has no top and is described by its type.
    """
    own = entities.select("entity_id", "parent_id", "type", "name")
    none = F.array().cast("array<struct<type: string, name: string>>")
    split = _split(own)
    tree = own if split is None else split[0]
    known = tree.select(F.col("entity_id").alias("parent_id")).distinct()
    tops = tree.join(known, "parent_id", "left_anti")

    def told(df):
        kept = F.when(F.size("path") > 1, F.filter("path", lambda p: ~p["type"].eqNullSafe(F.lit("campus")))).otherwise(F.col("path"))
        names = F.transform(F.coalesce(kept, none), lambda p: p["name"])
        return df.select("entity_id", F.concat_ws(" · ", F.array("type"), names).alias("description"))

    def up(level):
        return level.select(F.col("entity_id").alias("parent_id"), F.array_append("path", F.struct(F.col("type").cast("string").alias("type"), F.col("name").cast("string").alias("name"))).alias("path"))

    def below(level, children):
        return children.join(up(level), "parent_id").select("entity_id", "type", "name", "path")

    paths = descend(tops.select("entity_id", "type", "name", none.alias("path")), tree, below)
    if split is None:
        return told(own.join(paths.select("entity_id", "path"), "entity_id", "left"))
    stuck = tree.join(paths.select("entity_id"), "entity_id", "left_anti").select("entity_id", "type", "name", none.alias("path"))
    ends = split[1].join(up(paths), "parent_id", "left").select("entity_id", "type", "name", "path")
    return told(paths.unionByName(stuck).unionByName(ends))


def hierarchy_violations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Dangling parents, parent cycles, duplicate ids, relations without an end.

    Named ids fold before they are looked up, and only ids that something hangs from are walked: leaves, which most
    entities are, follow their parents. An entity lies on or below a cycle if all its rows hang from what no root reaches.
    """
    tally = cut_lineage(entities.groupBy("entity_id").agg(F.count("*").alias("n")))
    ids = tally.select("entity_id")
    named = entities.where("parent_id is not null").select("parent_id").distinct()
    named = cut_lineage(named.join(ids.select(F.col("entity_id").alias("parent_id"), F.lit(True).alias("known")), "parent_id", "left"))
    dangling = entities.join(named.where("known is null"), "parent_id", "left_semi")
    twice = tally.where("n > 1")
    inner = entities.join(named.where("known").select(F.col("parent_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "parent_id")
    inner = cut_lineage(inner.join(named, "parent_id", "left").select("entity_id", "parent_id", "known"))
    reached = descend(
        inner.where("known is null").select("entity_id"), inner.where("known").select("entity_id", "parent_id"),
        lambda f, c: c.join(f.withColumnRenamed("entity_id", "parent_id"), "parent_id").select("entity_id"),
    )
    stuck = named.where("known").select("parent_id").join(reached.select(F.col("entity_id").alias("parent_id")), "parent_id", "left_anti")
    hanging = cut_lineage(entities.join(cut_lineage(stuck), "parent_id", "left_semi").select("entity_id"))
    whole = hanging.groupBy("entity_id").agg(F.count("*").alias("hanging")).join(tally, "entity_id").where("hanging = n")
    cyclic = hanging.join(whole, "entity_id", "left_semi")
    ends = []
    for side in ("source_id", "target_id"):
        unknown = relations.select(F.col(side).alias("end")).distinct().join(ids.withColumnRenamed("entity_id", "end"), "end", "left_anti")
        bad = relations.join(unknown, F.col(side).eqNullSafe(F.col("end")), "left_semi")
        ends.append(bad.select(F.lit(f"relation-{side}").alias("rule"), F.col(side).alias("key")))
    parts = [
        dangling.select(F.lit("dangling-parent").alias("rule"), F.col("entity_id").alias("key")),
        twice.select(F.lit("duplicate-id").alias("rule"), F.col("entity_id").alias("key")),
        cyclic.select(F.lit("parent-cycle").alias("rule"), F.col("entity_id").alias("key")), *ends,
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are unknown, self loops, and nodes without an edge."""
    ids = nodes.select("node_id")
    unknown = [
        edges.join(ids.withColumnRenamed("node_id", c), c, "left_anti").select(F.lit(f"unknown-{c}").alias("rule"), F.col(c).alias("key"))
        for c in ("a", "b")
    ]
    loops = edges.where("a = b").select(F.lit("self-loop").alias("rule"), F.col("a").alias("key"))
    touched = edges.select(F.explode(F.array("a", "b")).alias("node_id"))
    alone = ids.join(touched, "node_id", "left_anti").select(F.lit("isolated").alias("rule"), F.col("node_id").alias("key"))
    return reduce(DataFrame.unionByName, [*unknown, loops, alone])


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected neighbours that are known nodes."""
    both = edges.select(F.col("a").alias("node_id"), F.col("b").alias("neighbour_id")).unionByName(
        edges.select(F.col("b").alias("node_id"), F.col("a").alias("neighbour_id"))
    ).distinct()
    ids = nodes.select("node_id")
    return both.join(ids, "node_id", "left_semi").join(ids.withColumnRenamed("node_id", "neighbour_id"), "neighbour_id", "left_semi")


# --- level-of-detail trees: node_id, parent_id, available, error --------------

def with_depth(nodes: DataFrame) -> DataFrame:
    """Depth of every node reachable from a root."""
    roots = nodes.where("parent_id is null").select("node_id", F.lit(0).alias("depth"))
    return descend(
        roots, nodes.select("node_id", "parent_id"),
        lambda f, c: c.join(f.withColumnRenamed("node_id", "parent_id"), "parent_id").select("node_id", (F.col("depth") + 1).alias("depth")),
    )


def frontier(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes to show: shallowest available node fine enough (or a leaf); where a subtree cannot
    be covered by available nodes, its parent is shown whole instead.

    nodes may have a column depth, which is then not walked for. Bottom-up: a node is covered by its descendants when every
    child is usable or covered. Top-down: show a covered node's children only while the node itself is too coarse.
    """
    known = cut_lineage(nodes if "depth" in nodes.columns else nodes.join(with_depth(nodes), "node_id"))
    kids = known.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    known = cut_lineage(known.join(kids, "node_id", "left").withColumn("final", (F.col("error") <= threshold) | F.col("kids").isNull()))
    deepest = known.agg(F.max("depth")).first()[0] or 0
    covered = None
    for d in range(deepest, -1, -1):
        here = known.where(F.col("depth") == d)
        if covered is None:
            tally = here.select("node_id", F.lit(0).cast("bigint").alias("good"))
        else:
            tally = covered.where("usable").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("good"))
        here = here.join(tally, "node_id", "left")
        whole = F.col("kids").isNotNull() & (F.coalesce(F.col("good"), F.lit(0)) == F.col("kids"))
        here = here.select(
            "node_id", "parent_id", "final", "available", (~F.col("final") & whole).alias("opens"),
            (F.col("available") | (~F.col("final") & whole)).alias("usable"),
        )
        covered = cut_lineage(here)
        state = covered if d == deepest else state.unionByName(covered)  # noqa: F821
    start = state.where("parent_id is null").select("node_id", "available", "opens")
    shown = descend(
        start, state.select("node_id", "parent_id", "available", "opens"),
        lambda f, c: c.join(f.where("opens").select(F.col("node_id").alias("parent_id")), "parent_id").select("node_id", "available", "opens"),
    )
    return shown.where("available and not opens").select("node_id")


def owners_at(nodes: DataFrame, level: int) -> DataFrame:
    """(node_id, owner_id): the ancestor of each node at the given depth, self included."""
    at = with_depth(nodes).where(F.col("depth") == level).select("node_id", F.col("node_id").alias("owner_id"))
    return descend(
        at, nodes.select("node_id", "parent_id"),
        lambda f, c: c.join(f.withColumnRenamed("node_id", "parent_id"), "parent_id").select("node_id", "owner_id"),
    )


def complete_frontier(nodes: DataFrame, threshold: float = 0.0, owner_level: int | None = None) -> DataFrame:
    """(node_id, owner_id, failing_id, reason, terminal): the cut of each tree at an error threshold, and what breaks it.

    Top-down: at a threshold above 0 an available node that is fine enough ends its branch; otherwise the branch goes on
    to the leaves, which at threshold 0 must have error 0. reason is NULL for a terminal row, else the first that holds of
    dangling-ancestor (failing_id: the unknown parent), missing-ancestor (failing_id: the one nearest the root),
    missing-node and coarse-leaf (failing_id: the row itself) or cycle (a leaf that no root reaches; failing_id NULL).
    owner_id: the ancestor of owner_level, NULL above it. Each level is one join, and what it carries is of fixed size.
    """
    ids = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    tree = nodes.select("node_id", "parent_id", "available", "error")
    inner = tree.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    tree = cut_lineage(tree.join(inner, "node_id", "left").withColumn("inner", F.coalesce("inner", F.lit(False))))
    fine = F.col("available") & (F.col("error") <= threshold) if threshold > 0 else F.lit(False)
    ends = ~F.col("inner") | fine

    def owner(depth, above):
        return F.when(depth == owner_level, F.col("node_id")).otherwise(above) if owner_level is not None else F.lit(None).cast(above_type)

    above_type = nodes.schema["node_id"].dataType
    unknown = tree.where("parent_id is not null").join(ids, "parent_id", "left_anti").withColumn("dangling", F.col("parent_id"))
    tops = tree.where("parent_id is null").withColumn("dangling", F.lit(None).cast(above_type)).unionByName(unknown)
    start = tops.select("node_id", "available", "error", "inner", "dangling", F.lit(None).cast(above_type).alias("missing"), F.lit(0).alias("depth"),
                        owner(F.lit(0), F.lit(None).cast(above_type)).alias("owner_id"), ends.alias("ends"))

    def step(level, children):
        up = level.where("not ends").select(F.col("node_id").alias("parent_id"), "dangling", "depth", F.col("owner_id").alias("above"),
                                            F.coalesce("missing", F.when(~F.col("available"), F.col("node_id"))).alias("missing"))
        down = children.join(up, "parent_id")
        return down.select("node_id", "available", "error", "inner", "dangling", "missing", (F.col("depth") + 1).alias("depth"),
                           owner(F.col("depth") + 1, F.col("above")).alias("owner_id"), ends.alias("ends"))

    walked = descend(start, tree, step)
    cut = walked.where("ends")
    coarse = (F.col("error") != 0) if threshold == 0 else F.lit(False)
    reason = (F.when(F.col("dangling").isNotNull(), "dangling-ancestor").when(F.col("missing").isNotNull(), "missing-ancestor")
              .when(~F.col("available"), "missing-node").when(coarse, "coarse-leaf"))
    failing = F.coalesce("dangling", "missing", F.when(~F.col("available") | coarse, F.col("node_id")))
    out = cut.select("node_id", "owner_id", failing.alias("failing_id"), reason.alias("reason"))
    # a leaf that hangs off a cycle is below no node that was walked
    loose = tree.where("not inner").join(walked.select("node_id"), "node_id", "left_anti")
    if threshold > 0:
        covered = descend(cut.select("node_id"), tree, lambda f, c: c.join(f.select(F.col("node_id").alias("parent_id")), "parent_id").select("node_id").distinct())
        loose = loose.join(covered, "node_id", "left_anti")
    loose = loose.select("node_id", F.lit(None).cast(above_type).alias("owner_id"), F.lit(None).cast(above_type).alias("failing_id"), F.lit("cycle").alias("reason"))
    return out.unionByName(loose).withColumn("terminal", F.col("reason").isNull())


def frontier_owners(cut: DataFrame) -> DataFrame:
    """(owner_id, nodes, failed, complete, first_failing) of each owner of a cut: complete if every row is terminal."""
    return cut.where("owner_id is not null").groupBy("owner_id").agg(
        F.count("*").alias("nodes"), F.count("reason").alias("failed"), F.bool_and("terminal").alias("complete"),
        F.min(F.when(F.col("reason").isNotNull(), F.col("failing_id"))).alias("first_failing"),
    )


def stage_violations(nodes: DataFrame, staged: DataFrame, planned: DataFrame, owner_level: int) -> DataFrame:
    """(rule, key): a staged set of leaves against the strict cut of its tree and the counts planned per owner.

    nodes: a tree as for complete_frontier; staged: node_id; planned: owner_id, leaves.
    """
    cut = cut_lineage(complete_frontier(nodes, 0.0, owner_level))
    want, have = cut.select("node_id"), staged.select("node_id").distinct()
    twice = staged.groupBy("node_id").count().where("count > 1")
    counts = planned.join(frontier_owners(cut), "owner_id", "full").where("not (leaves <=> nodes)")
    parts = [
        cut.where("not terminal").select(F.concat(F.lit("frontier-"), "reason").alias("rule"), F.col("node_id").alias("key")),
        want.join(have, "node_id", "left_anti").select(F.lit("leaf-not-staged").alias("rule"), F.col("node_id").alias("key")),
        have.join(want, "node_id", "left_anti").select(F.lit("staged-outside-frontier").alias("rule"), F.col("node_id").alias("key")),
        twice.select(F.lit("staged-twice").alias("rule"), F.col("node_id").alias("key")),
        counts.select(F.lit("owner-leaf-count").alias("rule"), F.col("owner_id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts)


def uncovered(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Leaves below no selected node."""
    below = descend(
        selected.select("node_id"), nodes.select("node_id", "parent_id"),
        lambda f, c: c.join(f.withColumnRenamed("node_id", "parent_id"), "parent_id").select("node_id").distinct(),
    )
    inner = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    return nodes.select("node_id").join(inner, "node_id", "left_anti").join(below, "node_id", "left_anti")
