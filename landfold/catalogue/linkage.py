"""Linkage, merges and classification by exact keys."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.catalogue.hierarchy import CHAIN
from landfold.functions import text
from landfold.operators import hierarchy as h, linkage as l


@query("d13_link_by_name", """WITH nw AS (SELECT p_partkey AS new_id, CASE WHEN p_partkey%50=0 THEN -p_partkey END AS own_id, lower(regexp_replace(p_name,'[^A-Za-z0-9]','','g')) AS key FROM part),
ex AS (SELECT lower(regexp_replace(p_name,'[^A-Za-z0-9]','','g')) AS key, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part WHERE p_partkey%40=1 GROUP BY 1)
SELECT new_id, coalesce(own_id, CASE WHEN lo=hi THEN lo END) AS linked_id, CASE WHEN own_id IS NOT NULL THEN 'own-id' WHEN lo IS NULL THEN 'new' WHEN lo=hi THEN 'exact-name' ELSE 'ambiguous' END AS how
FROM nw LEFT JOIN ex ON ex.key=nw.key""")
def _(t):
    new = t.part.select(F.col("p_partkey").alias("new_id"), F.when(F.col("p_partkey") % 50 == 0, -F.col("p_partkey")).alias("own_id"), F.upper("p_name").alias("name"))
    old = t.part.where("p_partkey % 40 = 1").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return l.link_by_name(new, old, text.norm_alnum("name"))


@query("d14_resolve_unique", """SELECT o_custkey AS key, CASE WHEN count(CASE WHEN o_totalprice>400000 THEN 1 END)=1 THEN max(CASE WHEN o_totalprice>400000 THEN o_orderkey END) END AS pick,
 count(CASE WHEN o_totalprice>400000 THEN 1 END) AS qualifying FROM orders GROUP BY o_custkey""")
def _(t):
    c = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pick"), "o_totalprice")
    return l.resolve_unique(c, "key", F.col("o_totalprice") > 400000, "pick")


@query("d15_merge_by_priority", """SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN 'outline' WHEN c_custkey%2=0 THEN 'reference' ELSE 'estimate' END AS source, CASE WHEN c_custkey%3=0 THEN c_acctbal WHEN c_custkey%2=0 THEN c_acctbal+1 ELSE c_acctbal+2 END AS v FROM customer""")
def _(t):
    def src(name, where, add):
        return t.customer.where(where).select(F.col("c_custkey").alias("id"), F.lit(name).alias("source"), (F.col("c_acctbal") + add).alias("v"))

    return l.merge_by_priority([src("outline", "c_custkey%3=0", 0.0), src("reference", "c_custkey%2=0", 1.0), src("estimate", "true", 2.0)], "id")


@query("d16_resolve_ids", "SELECT o_orderkey AS id, CASE WHEN o_custkey%4=0 THEN 'floor:'||o_custkey ELSE 'old:'||o_custkey END AS entity_id FROM orders")
def _(t):
    legacy = t.customer.where("c_custkey%4=0").select(F.concat(F.lit("old:"), F.col("c_custkey")).alias("legacy_id"), F.concat(F.lit("floor:"), F.col("c_custkey")).alias("entity_id"))
    return l.resolve_ids(t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("old:"), F.col("o_custkey")).alias("entity_id")), legacy, "entity_id")


CLASSES = [("canonical-building", "p_size%7=0"), ("aggregate-zone", "p_size%5=0"), ("named-space-or-wing", "p_partkey%4=0"), ("outdoor-landmark-or-network", "p_partkey%6=1")]


@query("d17_classify_inventory", "SELECT p_partkey AS id, CASE " + " ".join(f"WHEN {w} THEN '{c}'" for c, w in CLASSES) + " ELSE 'unclassified' END AS class FROM part")
def _(t):
    catalog = t.part.select(F.col("p_partkey").alias("id"))
    return l.classify_inventory(catalog, [(c, t.part.where(w).select(F.col("p_partkey").alias("id"))) for c, w in CLASSES])


@query("d18_bind_parts", """WITH refs AS (SELECT c_custkey AS entity_id, c_custkey%40 AS floor_id, CAST(c_custkey%3+i AS INTEGER) AS part_index FROM customer, range(0,2) q(i)),
rooms AS (SELECT p_partkey%40 AS floor_id, CAST(floor(p_partkey/40e0) AS INTEGER) AS part_index, p_name AS room FROM part WHERE p_partkey%11<>0)
SELECT r.entity_id, r.floor_id, r.part_index, m.room FROM refs r LEFT JOIN rooms m ON m.floor_id=r.floor_id AND m.part_index=r.part_index""")
def _(t):
    e = t.customer.select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") % 40).alias("floor_id"),
                          F.array((F.col("c_custkey") % 3).cast("int"), (F.col("c_custkey") % 3 + 1).cast("int")).alias("part_indices"))
    rooms = t.part.where("p_partkey%11<>0").select((F.col("p_partkey") % 40).alias("floor_id"), F.floor(F.col("p_partkey") / 40).cast("int").alias("part_index"), F.col("p_name").alias("room"))
    return l.bind_parts(e, rooms)


@query("d19_object_owner", """SELECT p_partkey AS source_object_id, CASE WHEN p_partkey%7=0 OR p_size%10=3 THEN NULL WHEN p_size%10=4 THEN 'bundle:'||p_partkey%20 WHEN p_partkey%3=0 THEN 'building:'||p_partkey ELSE 'bundle:'||p_partkey%20 END AS owner FROM part""")
def _(t):
    k = F.col("p_partkey")
    objects = t.part.select(k.alias("source_object_id"), F.concat(F.lit("bundle:"), k % 20).alias("bundle_id"),
                            F.when(k % 7 == 0, "source-photogrammetry-gap-surface").alias("role"),
                            F.when(F.col("p_size") % 10 == 3, "domain-only").when(F.col("p_size") % 10 == 4, "aggregate-source").alias("ownership"))
    objects = objects.fillna("plain", ["role", "ownership"])
    over = t.part.where("p_partkey%3=0").select(k.alias("source_object_id"), F.concat(F.lit("building:"), k).alias("entity_id"), F.lit(0).alias("ord"))
    return l.object_owner(objects, over)


@query("d20_missing", "SELECT path, bytes FROM inv_a a WHERE NOT EXISTS (SELECT 1 FROM inv_b b WHERE b.path=a.path)")
def _(t):
    return l.missing(t.inv_a.select("path", "bytes"), t.inv_b, ["path"])


STAGED = "staged AS (SELECT l_partkey AS id, l_suppkey%2 AS owner FROM lineitem WHERE l_linenumber=1)"


@query("d21_collisions", f"""WITH {STAGED} SELECT DISTINCT id, 'already-live' AS reason FROM staged WHERE id IN (SELECT p_partkey FROM part WHERE p_size<10)
UNION ALL SELECT id, 'two-owners' FROM staged GROUP BY id HAVING count(DISTINCT owner)>1""")
def _(t):
    staged = t.lineitem.where("l_linenumber=1").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 2).alias("owner"))
    return l.collisions(staged, t.part.where("p_size<10").select(F.col("p_partkey").alias("id")))


def bindings(t):
    return t.orders.where("o_orderkey%4=1").select(
        F.when(F.col("o_orderkey") % 8 == 1, F.concat(F.lit("floor:"), F.col("o_custkey"))).otherwise(F.concat(F.lit("building:"), F.col("o_custkey") % 17)).alias("target_id"),
        F.col("o_orderkey").alias("resource_id"), F.when(F.col("o_orderkey") % 3 == 0, "depicts").otherwise("nearby").alias("relation"))


@query("d31_related_resources", f"""WITH {CHAIN}, b AS (SELECT CASE WHEN o_orderkey%8=1 THEN 'floor:'||o_custkey ELSE 'building:'||(o_custkey%17) END AS target_id, o_orderkey AS resource_id, CASE WHEN o_orderkey%3=0 THEN 'depicts' ELSE 'nearby' END AS relation FROM orders WHERE o_orderkey%4=1)
SELECT c.entity_id, count(DISTINCT b.resource_id) AS resources, count(DISTINCT CASE WHEN relation='depicts' THEN resource_id END) AS depicting FROM chain c JOIN entities e ON e.entity_id=c.ancestor_id JOIN b ON b.target_id=c.ancestor_id
WHERE c.depth=0 OR e.type IN ('floor','building') GROUP BY c.entity_id""")
def _(t):
    r = l.related_resources(h.nearest_of_type(t.entities, "floor", "building"), bindings(t))
    # Rows are distinct, so plain counts are distinct counts.
    return r.groupBy("entity_id").agg(F.count("*").alias("resources"), F.count(F.when(F.col("relation") == "depicts", 1)).alias("depicting"))


@query("d32_floor_connectors", f"""WITH con AS (SELECT s.entity_id, s.parent_id AS floor_id, f.parent_id AS building FROM entities s JOIN entities f ON f.entity_id=s.parent_id WHERE s.type='connector'),
st AS (SELECT entity_id, 'floor:'||((CAST(split_part(entity_id,':',2) AS BIGINT)*2)%(SELECT count(*) FROM customer)) AS floor_id FROM con),
al AS (SELECT entity_id, floor_id, building FROM con UNION SELECT s.entity_id, s.floor_id, c.building FROM st s JOIN con c ON c.entity_id=s.entity_id)
SELECT a.floor_id, a.entity_id FROM al a JOIN entities f ON f.entity_id=a.floor_id AND f.parent_id=a.building""")
def _(t):
    n = t.customer.count()
    places = h.nearest_of_type(t.entities, "floor", "building").join(t.entities.select("entity_id", "type"), "entity_id")
    stops = t.entities.where("type='connector'").select("entity_id", F.concat(F.lit("floor:"), (F.split("entity_id", ":")[1].cast("bigint") * 2) % n).alias("floor_id"))
    return l.floor_connectors(places, stops)


@query("d33_merge_local_first", "SELECT path, bytes FROM inv_a UNION ALL SELECT path, bytes FROM inv_b WHERE path NOT IN (SELECT path FROM inv_a)")
def _(t):
    return l.merge_local_first(t.inv_a.select("path", "bytes"), t.inv_b.select("path", "bytes"), "path")


@query("d34_match_by_hash", "SELECT a.path, f.file FROM inv_a a LEFT JOIN (SELECT sha256, min(path) AS file FROM inv_b GROUP BY 1) f ON f.sha256=a.sha256")
def _(t):
    return l.match_by_hash(t.inv_a.select("path", "sha256"), t.inv_b).select("path", "file")


@query("d35_fan_out", """WITH ph AS (SELECT o_orderkey AS photo_id, 'h'||(o_custkey%60) AS prefix, CASE WHEN o_orderkey%2=0 THEN 'h'||(o_custkey%60) ELSE 'h'||(o_custkey%60)||'-east' END AS place FROM orders WHERE o_orderstatus='F'),
mp AS (SELECT 'h'||s_suppkey||CASE WHEN s_suppkey%4=0 THEN '-east' ELSE '' END AS place, s_suppkey AS k FROM supplier)
SELECT p.photo_id, 'e'||(coalesce(m.k,q.k)+i) AS entity_id FROM ph p LEFT JOIN mp m ON m.place=p.place LEFT JOIN mp q ON q.place=p.prefix, range(0,2) r(i) WHERE coalesce(m.k,q.k) IS NOT NULL""")
def _(t):
    h_ = F.concat(F.lit("h"), F.col("o_custkey") % 60)
    photos = t.orders.select(F.col("o_orderkey").alias("photo_id"), F.when(F.col("o_orderkey") % 2 == 0, h_).otherwise(F.concat(h_, F.lit("-east"))).alias("place"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    k = F.col("s_suppkey")
    mapping = t.supplier.select(F.concat(F.lit("h"), k, F.when(k % 4 == 0, "-east").otherwise("")).alias("place"), F.array(F.concat(F.lit("e"), k), F.concat(F.lit("e"), k + 1)).alias("entities"))
    return l.fan_out(photos, mapping)


@query("d36_resolve_index", """SELECT p_partkey AS doc_id, CAST(m AS INTEGER) AS material, CAST((p_size+m)%3 AS INTEGER) AS texture, CAST((p_partkey+(p_size+m)%3)%2 AS INTEGER) AS image, 'img'||p_partkey||'_'||((p_partkey+(p_size+m)%3)%2) AS uri FROM part, range(0,4) q(m)""")
def _(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    doc = t.part.select(k.alias("doc_id"), F.array(*[(s + m) % 3 for m in range(4)]).alias("materials"), F.array(*[((k + x) % 2).cast("int") for x in range(3)]).alias("textures"),
                        F.array(*[F.concat(F.lit("img"), k, F.lit(f"_{i}")) for i in range(2)]).alias("images"))
    return l.resolve_index(doc)
