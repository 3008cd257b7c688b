"""Registry integrity as a table of declarative rules.

A rule names a table, what makes a row wrong, and the key to report; report() compiles all rules together:

* Row rules of a table are one pass over it: an array of (rule, key) of what fails, exploded.
* Known rules (foreign keys) that point at the same column share one anti-join: the tables' references are exploded in
  one pass each, stacked, and what the column holds is removed. A coverage rule is the same thing the other way round.
* Unique rules are stacked as (rule, value) too, and one grouping finds values that occur twice, or belong to two owners.
* Group rules of the same table and key share one grouping.
* Match rules of the same two tables and keys share one join.
* Tree rules are hierarchy.hierarchy_violations().

References and values fold before they are shuffled, so a target that a third of all rows name costs one row per task.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.operators import hierarchy


@dataclass(frozen=True)
class Row:
    """A row is wrong where `broken` holds; NULL counts as right."""

    name: str
    table: str
    broken: str
    key: str


@dataclass(frozen=True)
class Known:
    """Every non-NULL value must be among the target's; key is what is reported, the value itself if None."""

    name: str
    table: str
    value: str
    target: str
    column: str
    key: str | None = None


@dataclass(frozen=True)
class Unique:
    """No value twice; with an owner, no value of two owners."""

    name: str
    table: str
    value: str
    owner: str | None = None


@dataclass(frozen=True)
class Group:
    """Groups by `by` for which the aggregate condition holds are wrong."""

    name: str
    table: str
    by: str
    broken: str


@dataclass(frozen=True)
class Match:
    """Rows of a (alias a) and b (alias b) that meet on equal columns and for which `broken` holds."""

    name: str
    a: str
    b: str
    on: tuple[tuple[str, str], ...]
    broken: str
    key: str


Rule = Row | Known | Unique | Group | Match


def _failing(df: DataFrame, wrong: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, key) of every rule (name, condition, key) that a row breaks, in one pass."""
    made = [F.when(F.expr(f"coalesce({test}, false)"), F.struct(F.lit(name).alias("rule"), F.expr(f"cast({key} AS string)").alias("key"))) for name, test, key in wrong]
    return df.select(F.inline(F.array_compact(F.array(*made))))


def _stacked(tables: dict[str, DataFrame], rules: list, value: str, extra: dict[str, str]) -> DataFrame:
    """(rule, value, extra columns) of some rules, one pass per table."""
    by_table: dict[str, list] = defaultdict(list)
    for rule in rules:
        by_table[rule.table].append(rule)
    parts = []
    for table, some in by_table.items():
        made = [F.struct(F.lit(r.name).alias("rule"), F.expr(f"cast({getattr(r, value)} AS string)").alias("value"),
                         *[F.expr(f"cast({getattr(r, attr) or default} AS string)").alias(name) for name, (attr, default) in extra.items()]) for r in some]
        parts.append(tables[table].select(F.inline(F.array(*made))))
    return reduce(DataFrame.unionByName, parts)


def violations(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(rule, key) of everything that the rules find."""
    kinds: dict[type, list] = defaultdict(list)
    for rule in rules:
        kinds[type(rule)].append(rule)
    parts: list[DataFrame] = []

    by_table: dict[str, list[Row]] = defaultdict(list)
    for rule in kinds[Row]:
        by_table[rule.table].append(rule)
    parts += [_failing(tables[table], [(r.name, r.broken, r.key) for r in some]) for table, some in by_table.items()]

    by_target: dict[tuple[str, str], list[Known]] = defaultdict(list)
    for rule in kinds[Known]:
        by_target[rule.target, rule.column].append(rule)
    for (target, column), some in by_target.items():
        named = _stacked(tables, some, "value", {"key": ("key", "null")}).where("value is not null").distinct()
        held = tables[target].select(F.expr(f"cast({column} AS string)").alias("value"))
        parts.append(named.join(held, "value", "left_anti").select("rule", F.coalesce("key", "value").alias("key")).distinct())

    if kinds[Unique]:
        stacked = _stacked(tables, kinds[Unique], "value", {"owner": ("owner", "null")}).where("value is not null")
        owned = F.lit(False)
        for rule in kinds[Unique]:
            if rule.owner:
                owned = owned | (F.col("rule") == rule.name)
        folded = stacked.withColumn("owned", owned).groupBy("rule", "value", "owned").agg(F.count("*").alias("n"), F.min("owner").alias("lo"), F.max("owner").alias("hi"))
        parts.append(folded.where("(not owned and n > 1) or (owned and lo <> hi)").select("rule", F.col("value").alias("key")))

    by_group: dict[tuple[str, str], list[Group]] = defaultdict(list)
    for rule in kinds[Group]:
        by_group[rule.table, rule.by].append(rule)
    for (table, by), some in by_group.items():
        grouped = tables[table].groupBy(F.expr(by).alias("by")).agg(*[F.expr(r.broken).alias(f"c{i}") for i, r in enumerate(some)])
        parts.append(_failing(grouped, [(r.name, f"c{i}", "`by`") for i, r in enumerate(some)]))

    by_pair: dict[tuple, list[Match]] = defaultdict(list)
    for rule in kinds[Match]:
        by_pair[rule.a, rule.b, rule.on].append(rule)
    for (a, b, on), some in by_pair.items():
        same = reduce(lambda x, y: x & y, [F.col(f"a.{x}") == F.col(f"b.{y}") for x, y in on])
        parts.append(_failing(tables[a].alias("a").join(tables[b].alias("b"), same), [(r.name, r.broken, r.key) for r in some]))
    return reduce(DataFrame.unionByName, parts)


def report(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(rule, key) of all rules and of the tree of tables["entity"] with tables["relation"]."""
    tree = hierarchy.hierarchy_violations(tables["entity"].select("entity_id", "parent_id"), tables["relation"].select("source_id", "target_id"))
    return violations(tables, rules).unionByName(tree.select("rule", F.col("key").cast("string").alias("key")))


TREE_RULES = ("dangling-parent", "duplicate-id", "parent-cycle", "relation-source_id", "relation-target_id")


def summary(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, violations, first_key) of every rule, passed ones with 0."""
    names = found.sparkSession.createDataFrame([(r,) for r in (*TREE_RULES, *(r.name for r in rules))], "rule string")
    counts = found.groupBy("rule").agg(F.count("*").alias("violations"), F.min("key").alias("first_key"))
    return names.join(counts, "rule", "left").fillna(0, ["violations"])


def rules() -> list[Rule]:
    """The registry's rules. Tables: entity, relation, rep, part, rep_part, stop, legacy, campus, asset, resource, binding, link, street, segment, bundle, object, mask."""
    return [
        # identity
        Row("blank-name", "entity", "trim(name) = ''", "entity_id"),
        Row("toilet-not-a-space", "entity", "function = 'toilet' AND type <> 'space'", "entity_id"),
        Unique("location-of-two-entities", "entity", "location_id", "entity_id"),
        Known("location-unknown-to-drawings", "entity", "location_id", "part", "location_id", "entity_id"),
        Known("legacy-target", "legacy", "entity_id", "entity", "entity_id", "campus_id"),
        Known("legacy-without-catalogue", "legacy", "campus_id", "campus", "campus_id"),
        Known("catalogue-without-legacy", "campus", "campus_id", "legacy", "campus_id"),
        # representations
        Unique("duplicate-representation", "rep", "rep_id"),
        Known("representation-owner", "rep", "entity_id", "entity", "entity_id", "rep_id"),
        Known("representation-asset", "rep", "asset", "asset", "path", "rep_id"),
        Known("representation-floor", "rep", "floor_id", "entity", "entity_id", "rep_id"),
        Row("bounds", "rep", "isnan(min_x) OR isnan(max_x) OR isnan(min_y) OR isnan(max_y) OR min_x > max_x OR min_y > max_y", "rep_id"),
        Match("representation-floor-type", "rep", "entity", (("floor_id", "entity_id"),), "b.type <> 'floor'", "a.rep_id"),
        # drawn parts of rooms
        Known("part-index", "rep_part", "part_key", "part", "part_key", "rep_id"),
        Unique("part-of-two-owners", "rep_part", "part_key", "entity_id"),
        Match("background-as-room", "rep_part", "part", (("part_key", "part_key"),), "NOT b.interactive", "a.part_key"),
        Match("part-location", "rep_part", "part", (("part_key", "part_key"),), "a.location_id <> b.location_id", "a.part_key"),
        Known("part-not-covered", "part", "CASE WHEN interactive THEN part_key END", "rep_part", "part_key"),
        Group("flattened-room-height", "rep_part", "rep_id", "min(part_z) <> min(rep_lo) OR max(part_z) <> max(rep_hi)"),
        # connector stops
        Known("stop-floor", "stop", "floor_id", "entity", "entity_id", "stop_id"),
        Known("stop-representation", "stop", "rep_id", "rep", "rep_id", "stop_id"),
        Match("stop-floor-differs", "stop", "rep", (("rep_id", "rep_id"),), "a.floor_id <> b.floor_id", "a.stop_id"),
        Known("stop-part-outside", "stop", "concat(rep_id, '/', part_key)", "rep_part", "concat(rep_id, '/', part_key)", "stop_id"),
        Match("stop-location", "stop", "part", (("part_key", "part_key"),), "a.location_id <> b.location_id", "a.stop_id"),
        Match("stop-position", "stop", "part", (("part_key", "part_key"),), "a.x <> b.x OR a.z <> b.z OR a.y <> b.y", "a.stop_id"),
        Row("stop-door", "stop", "door_side IS NOT NULL", "stop_id"),
        # outdoor lines
        Match("street-entity", "segment", "street", (("street_code", "street_code"),), "a.entity_id <> b.entity_id", "a.segment_id"),
        Known("street-code", "segment", "street_code", "street", "street_code", "segment_id"),
        Row("line-valid", "segment", "isnan(x1) OR isnan(z1) OR isnan(x2) OR isnan(z2) OR (x1 = x2 AND z1 = z2)", "segment_id"),
        Row("deck-height", "segment", "deck_height IS NOT NULL", "segment_id"),
        Row("tunnel-on-ground", "segment", "street_type = 'Tunnel' AND show_ground", "segment_id"),
        Unique("segment-twice", "segment", "segment_id"),
        Group("street-lines", "segment", "street_code", "count(*) <> max(declared_lines)"),
        # exterior bundles
        Known("bundle-owner", "bundle", "entity_id", "entity", "entity_id", "bundle_id"),
        Row("range-with-building", "bundle", "is_range AND building_id IS NOT NULL", "bundle_id"),
        Row("building-without-id", "bundle", "NOT is_range AND building_id IS NULL", "bundle_id"),
        Row("building-id-differs", "bundle", "NOT is_range AND concat('building:', building_id) <> entity_id", "bundle_id"),
        Match("range-ownership", "object", "bundle", (("bundle_id", "bundle_id"),), "b.is_range AND a.ownership <> 'aggregate-source'", "a.object_id"),
        Match("object-placed", "object", "bundle", (("bundle_id", "bundle_id"),), "a.offset_x <> b.offset_x", "a.object_id"),
        Known("object-bundle", "object", "bundle_id", "bundle", "bundle_id", "object_id"),
        Group("bundle-objects", "object", "bundle_id", "count(*) <> max(declared_objects)"),
        Unique("object-in-two-bundles", "object", "object_id", "bundle_id"),
        Match("mask-projection", "mask", "bundle", (("bundle_id", "bundle_id"),), "a.width <> b.width OR a.height <> b.height", "a.bundle_id"),
        Row("mask-bytes", "mask", "bytes <> width * height * 4", "bundle_id"),
        Known("bundle-without-mask", "bundle", "bundle_id", "mask", "bundle_id"),
        # resources
        Unique("duplicate-resource", "resource", "resource_id"),
        Known("resource-asset", "resource", "asset", "asset", "path", "resource_id"),
        Known("binding-target", "binding", "entity_id", "entity", "entity_id", "resource_id"),
        Known("binding-resource", "binding", "resource_id", "resource", "resource_id"),
        Known("link-from", "link", "from_id", "resource", "resource_id"),
        Known("link-to", "link", "to_id", "resource", "resource_id"),
        Row("link-to-itself", "link", "from_id = to_id", "from_id"),
    ]
