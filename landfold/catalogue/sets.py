"""Set operations, de-duplication and upserts."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.operators import linkage as l


@query("h1_union_sources", "SELECT CAST(s_suppkey AS BIGINT) AS id, s_acctbal AS area, CAST(NULL AS VARCHAR) AS name, 'footprint' AS provenance FROM supplier UNION ALL SELECT c_custkey, NULL, c_name, 'named-domain' FROM customer")
def _(t):
    return l.union_sources(("footprint", t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("area"))),
                           ("named-domain", t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))


@query("h2_unique_last", "SELECT l_partkey AS id, l_orderkey AS ord, round(q,2) AS q FROM (SELECT l_partkey, l_orderkey, max(l_extendedprice) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS rn FROM lineitem GROUP BY 1,2) x WHERE rn=1")
def _(t):
    df = t.lineitem.groupBy(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("ord")).agg(F.round(F.max("l_extendedprice"), 2).alias("q"))
    return l.unique_last(df, "id", "ord")


@query("h3_sym_diff", "SELECT path, 'only-a' AS side FROM (SELECT path FROM inv_a EXCEPT SELECT path FROM inv_b) x UNION ALL SELECT path, 'only-b' FROM (SELECT path FROM inv_b EXCEPT SELECT path FROM inv_a) y")
def _(t):
    return l.sym_diff(t.inv_a, t.inv_b, "path")


@query("h4_inventory_diff", """SELECT coalesce(a.path,b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM inv_a a FULL JOIN inv_b b ON a.path=b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.bytes IS DISTINCT FROM b.bytes OR a.sha256 IS DISTINCT FROM b.sha256""")
def _(t):
    return l.inventory_diff(t.inv_a, t.inv_b, "path", ["bytes", "sha256"])


@query("h5_superset_gaps", "SELECT DISTINCT path FROM inv_a WHERE path NOT IN (SELECT path FROM inv_b)")
def _(t):
    return l.missing(t.inv_a, t.inv_b, ["path"]).select("path").distinct()


@query("h6_upsert_state", """WITH p AS (SELECT c_custkey AS id, c_acctbal AS area, CASE WHEN c_custkey%3=0 THEN 'approved' ELSE 'open' END AS status FROM customer WHERE c_custkey%5<>0),
f AS (SELECT c_custkey AS id, c_acctbal*2 AS area FROM customer WHERE c_custkey%7<>0)
SELECT coalesce(p.id,f.id) AS id, CASE WHEN f.id IS NOT NULL THEN f.area ELSE p.area END AS area, CASE WHEN p.id IS NOT NULL THEN p.status ELSE 'unreviewed' END AS status, CASE WHEN p.id IS NOT NULL AND f.id IS NOT NULL THEN 'refreshed' WHEN f.id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action
FROM p FULL JOIN f ON f.id=p.id""")
def _(t):
    k = F.col("c_custkey")
    prior = t.customer.where("c_custkey%5<>0").select(k.alias("id"), F.col("c_acctbal").alias("area"), F.when(k % 3 == 0, "approved").otherwise("open").alias("status"))
    fresh = t.customer.where("c_custkey%7<>0").select(k.alias("id"), (F.col("c_acctbal") * 2).alias("area"))
    return l.upsert_state(prior, fresh, "id", ["status"], {"status": "unreviewed"})


@query("h7_intersect_owners", "SELECT l_suppkey%50 AS owner FROM lineitem WHERE l_returnflag='R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey%3=0")
def _(t):
    return t.lineitem.where("l_returnflag='R'").select((F.col("l_suppkey") % 50).alias("owner")).intersect(t.supplier.where("s_suppkey%3=0").select(F.col("s_suppkey").alias("owner")))


@query("h8_add_relations", """WITH r AS (SELECT 'zone:'||s_nationkey AS source_id, 'building:'||s_suppkey AS target_id, 'contains' AS type FROM supplier),
n AS (SELECT 'zone:'||c_nationkey AS source_id, 'building:'||(c_custkey%40) AS target_id, CASE WHEN c_custkey%2=0 THEN 'contains' ELSE 'near' END AS type FROM customer)
SELECT * FROM r UNION SELECT * FROM n UNION SELECT target_id, source_id, CASE type WHEN 'contains' THEN 'containedBy' ELSE 'near' END FROM n""")
def _(t):
    rel = t.supplier.select(F.concat(F.lit("zone:"), "s_nationkey").alias("source_id"), F.concat(F.lit("building:"), "s_suppkey").alias("target_id"), F.lit("contains").alias("type"))
    new = t.customer.select(F.concat(F.lit("zone:"), "c_nationkey").alias("source_id"), F.concat(F.lit("building:"), F.col("c_custkey") % 40).alias("target_id"),
                            F.when(F.col("c_custkey") % 2 == 0, "contains").otherwise("near").alias("type"))
    return l.add_relations(rel, new, {"contains": "containedBy", "near": "near"})


@query("h9_propagate_update", """WITH m AS (SELECT l_suppkey AS manifest_id, l_partkey AS tile_id, l_orderkey AS bytes FROM lineitem), u AS (SELECT p_partkey+p_partkey%2*100000000000 AS tile_id, CAST(p_size AS BIGINT) AS bytes FROM part WHERE p_size<20),
g AS (SELECT m.manifest_id, m.tile_id, count(*) AS times, sum(m.bytes) AS bytes, max(u.bytes) AS nb FROM m LEFT JOIN u ON u.tile_id=m.tile_id GROUP BY 1,2)
SELECT manifest_id, CAST(sum(times) AS BIGINT) AS tiles, CAST(sum(CASE WHEN nb IS NULL OR times>1 THEN bytes ELSE nb END) AS BIGINT) AS bytes, count(CASE WHEN nb IS NOT NULL AND times=1 THEN 1 END) AS replaced, count(CASE WHEN nb IS NOT NULL AND times>1 THEN 1 END) AS errors FROM g GROUP BY 1
UNION ALL SELECT NULL, 0, 0, 0, count(*) FROM u WHERE tile_id NOT IN (SELECT tile_id FROM m)""")
def _(t):
    m = t.lineitem.select(F.col("l_suppkey").alias("manifest_id"), F.col("l_partkey").alias("tile_id"), F.col("l_orderkey").alias("bytes"))
    u = t.part.where("p_size<20").select((F.col("p_partkey") + F.col("p_partkey") % 2 * 100000000000).alias("tile_id"), F.col("p_size").cast("bigint").alias("bytes"))
    return l.propagate_update(m, u)
