"""Trees and graphs."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.operators import hierarchy as h

CHAIN = """chain AS (SELECT entity_id, entity_id AS ancestor_id, 0 AS depth FROM entities
 UNION ALL SELECT c.entity_id, e.parent_id, c.depth+1 FROM chain c JOIN entities e ON e.entity_id=c.ancestor_id WHERE e.parent_id IS NOT NULL)"""


def relations(t):
    """Relations between buildings and zones, a few of them without a target."""
    return t.sql("""SELECT concat('zone:',CAST(s_nationkey AS STRING)) AS source_id, concat('building:',CAST((s_suppkey*7+3)%((SELECT count(*) FROM supplier)+2) AS STRING)) AS target_id,
        CASE WHEN s_suppkey%5=0 THEN 'adjacentTo' ELSE 'contains' END AS type FROM supplier""")


REL = """rel AS (SELECT concat('zone:',s_nationkey) AS source_id, concat('building:',(s_suppkey*7+3)%((SELECT count(*) FROM supplier)+2)) AS target_id,
 CASE WHEN s_suppkey%5=0 THEN 'adjacentTo' ELSE 'contains' END AS type FROM supplier)"""


@query("g1_ancestors", f"WITH {CHAIN} SELECT entity_id, ancestor_id, depth FROM chain")
def _(t):
    return h.ancestors(t.entities)


@query("g1_nearest_of_type", f"WITH {CHAIN}, ty AS (SELECT c.entity_id, c.ancestor_id, c.depth, e.type FROM chain c JOIN entities e ON e.entity_id=c.ancestor_id) SELECT entity_id, max(CASE WHEN type='building' THEN ancestor_id END) AS building, max(CASE WHEN type='floor' THEN ancestor_id END) AS floor FROM ty GROUP BY entity_id")
def _(t):
    return h.nearest_of_type(t.entities, "building", "floor")


@query("g2_zone_members", f"""WITH {REL} SELECT parent_id AS zone_id, entity_id AS member_id FROM entities WHERE parent_id LIKE 'zone:%'
UNION SELECT r.source_id, r.target_id FROM rel r JOIN entities e ON e.entity_id=r.target_id WHERE r.type='contains'""")
def _(t):
    return h.zone_members(t.entities, relations(t))


@query("g6_lod_frontier", """WITH RECURSIVE d AS (SELECT node_id, parent_id, available, 0 AS depth FROM lod_node WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, n.parent_id, n.available, d.depth+1 FROM lod_node n JOIN d ON n.parent_id=d.node_id),
 k AS (SELECT parent_id, count(*) AS kids FROM lod_node WHERE parent_id IS NOT NULL GROUP BY 1),
 s AS (SELECT d.*, coalesce(kids,0) AS kids, 64e0/pow(4e0,depth) <= 1e0 OR kids IS NULL AS fin FROM d LEFT JOIN k ON k.parent_id=d.node_id),
 -- threshold 1 is reached at depth 3: unroll the bottom-up completeness by level
 u3 AS (SELECT node_id, parent_id, available AS usable, FALSE AS opens, available FROM s WHERE depth=3),
 c2 AS (SELECT parent_id, sum(CASE WHEN usable THEN 1 ELSE 0 END) AS good FROM u3 GROUP BY 1),
 u2 AS (SELECT s.node_id, s.parent_id, s.available OR (NOT fin AND kids=coalesce(good,0)) AS usable, NOT fin AND kids=coalesce(good,0) AS opens, s.available FROM s LEFT JOIN c2 ON c2.parent_id=s.node_id WHERE depth=2),
 c1 AS (SELECT parent_id, sum(CASE WHEN usable THEN 1 ELSE 0 END) AS good FROM u2 GROUP BY 1),
 u1 AS (SELECT s.node_id, s.parent_id, s.available OR (NOT fin AND kids=coalesce(good,0)) AS usable, NOT fin AND kids=coalesce(good,0) AS opens, s.available FROM s LEFT JOIN c1 ON c1.parent_id=s.node_id WHERE depth=1),
 c0 AS (SELECT parent_id, sum(CASE WHEN usable THEN 1 ELSE 0 END) AS good FROM u1 GROUP BY 1),
 u0 AS (SELECT s.node_id, s.parent_id, s.available OR (NOT fin AND kids=coalesce(good,0)) AS usable, NOT fin AND kids=coalesce(good,0) AS opens, s.available FROM s LEFT JOIN c0 ON c0.parent_id=s.node_id WHERE depth=0),
 allu AS (SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u3),
 shown AS (SELECT node_id, available, opens FROM allu WHERE parent_id IS NULL UNION ALL SELECT a.node_id, a.available, a.opens FROM allu a JOIN shown p ON a.parent_id=p.node_id AND p.opens)
SELECT node_id FROM shown WHERE available AND NOT opens""")
def _(t):
    return h.frontier(lod(t, "depth"), 1.0)


def lod(t, *more):
    """Error halves twice per level, from 64 at the root. more: "depth" to have it in a column."""
    depth = h.with_depth(t.lod_node)
    return t.lod_node.join(depth, "node_id").select("node_id", "parent_id", "available", (F.lit(64.0) / F.pow(F.lit(4.0), "depth")).alias("error"), *more)


@query("g7_owners_at", """WITH RECURSIVE d AS (SELECT node_id, 0 AS depth, CAST(NULL AS BIGINT) AS owner_id FROM lod_node WHERE parent_id IS NULL
 UNION ALL SELECT n.node_id, d.depth+1, CASE WHEN d.depth+1=2 THEN n.node_id ELSE d.owner_id END FROM lod_node n JOIN d ON n.parent_id=d.node_id)
SELECT node_id, owner_id FROM d WHERE depth>=2""")
def _(t):
    return h.owners_at(t.lod_node, 2)


#: lost nodes leave dangling children; two nodes name each other and so hang off no root
STAGED = """SELECT node_id, CASE WHEN node_id=40 THEN 161 WHEN node_id=161 THEN 40 ELSE parent_id END AS parent_id, available,
    CASE WHEN node_id%31=12 THEN 1e0 ELSE 0e0 END AS error FROM lod_node WHERE node_id%97<>11"""


def strict_sql(nodes: str, cut: str, coarse: str, level: int) -> str:
    """The cut from the rule itself: every node is followed from its top, and a branch stops where the rule says so."""
    return f"""nd AS ({nodes}), inn AS (SELECT DISTINCT parent_id AS node_id FROM nd WHERE parent_id IS NOT NULL),
 tr AS (SELECT n.*, i.node_id IS NOT NULL AS inr FROM nd n LEFT JOIN inn i ON i.node_id=n.node_id),
 wk AS (SELECT node_id, available, error, inr, parent_id AS dang, CAST(NULL AS BIGINT) AS miss, 0 AS depth, CASE WHEN {level}=0 THEN node_id END AS owner_id, NOT inr OR {cut} AS ends
   FROM tr WHERE parent_id IS NULL OR parent_id NOT IN (SELECT node_id FROM nd)
  UNION ALL SELECT c.node_id, c.available, c.error, c.inr, w.dang, CASE WHEN w.miss IS NULL AND NOT w.available THEN w.node_id ELSE w.miss END, w.depth+1,
   CASE WHEN w.depth+1={level} THEN c.node_id ELSE w.owner_id END, NOT c.inr OR {cut.replace("available", "c.available").replace("error", "c.error")} FROM tr c JOIN wk w ON c.parent_id=w.node_id AND NOT w.ends),
 under AS (SELECT node_id FROM wk UNION SELECT n.node_id FROM tr n JOIN under u ON n.parent_id=u.node_id),
 fr AS (SELECT node_id, owner_id, CASE WHEN dang IS NOT NULL THEN 'dangling-ancestor' WHEN miss IS NOT NULL THEN 'missing-ancestor' WHEN NOT available THEN 'missing-node' WHEN {coarse} THEN 'coarse-leaf' END AS reason,
   CASE WHEN dang IS NOT NULL THEN dang WHEN miss IS NOT NULL THEN miss WHEN NOT available OR {coarse} THEN node_id END AS failing_id FROM wk WHERE ends
  UNION ALL SELECT node_id, NULL, 'cycle', NULL FROM tr WHERE NOT inr AND node_id NOT IN (SELECT node_id FROM under))"""


@query("g7_complete_frontier", f"""WITH RECURSIVE {strict_sql(STAGED, "FALSE", "error<>0", 3)} SELECT node_id, owner_id, failing_id, reason, reason IS NULL AS terminal FROM fr""")
def _(t):
    return h.complete_frontier(t.sql(STAGED), owner_level=3)


COARSE = STAGED.replace("CASE WHEN node_id%31=12 THEN 1e0 ELSE 0e0 END", "CASE WHEN node_id<5 THEN 16e0 WHEN node_id<85 THEN 4e0 WHEN node_id%3=0 THEN 1e0 ELSE 2e0 END")


@query("g7_cut_at_error", f"""WITH RECURSIVE {strict_sql(COARSE, "(available AND error<=1e0)", "FALSE", 2)} SELECT node_id, owner_id, failing_id, reason, reason IS NULL AS terminal FROM fr""")
def _(t):
    return h.complete_frontier(t.sql(COARSE), 1.0, 2)


@query("g7_frontier_owners", f"""WITH RECURSIVE {strict_sql(STAGED, "FALSE", "error<>0", 3)} SELECT owner_id, count(*) AS nodes, count(reason) AS failed, count(reason)=0 AS complete, min(failing_id) AS first_failing FROM fr WHERE owner_id IS NOT NULL GROUP BY 1""")
def _(t):
    return h.frontier_owners(h.complete_frontier(t.sql(STAGED), owner_level=3))


@query("g8_uncovered_leaves", """WITH RECURSIVE below AS (SELECT node_id FROM lod_node WHERE node_id%29=5 UNION SELECT n.node_id FROM lod_node n JOIN below b ON n.parent_id=b.node_id)
SELECT node_id FROM lod_node n WHERE NOT EXISTS (SELECT 1 FROM lod_node c WHERE c.parent_id=n.node_id) AND node_id NOT IN (SELECT node_id FROM below)""")
def _(t):
    return h.uncovered(t.lod_node, t.lod_node.where("node_id % 29 = 5"))


@query("g10_hierarchy_violations", f"""WITH {REL}, bad AS (SELECT entity_id, CASE WHEN entity_id='floor:7' THEN 'building:none' WHEN entity_id='building:3' THEN 'floor:3' WHEN entity_id='floor:3' THEN 'building:3' ELSE parent_id END AS parent_id FROM entities
  UNION ALL SELECT entity_id, parent_id FROM entities WHERE type='zone' AND name LIKE '%7'),
reach AS (SELECT entity_id FROM bad b WHERE NOT EXISTS (SELECT 1 FROM bad p WHERE p.entity_id=b.parent_id) UNION SELECT b.entity_id FROM bad b JOIN reach r ON b.parent_id=r.entity_id)
SELECT 'dangling-parent' AS rule, entity_id AS key FROM bad b WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad p WHERE p.entity_id=b.parent_id)
UNION ALL SELECT 'duplicate-id', entity_id FROM bad GROUP BY entity_id HAVING count(*)>1
UNION ALL SELECT 'parent-cycle', entity_id FROM bad b WHERE entity_id NOT IN (SELECT entity_id FROM reach)
UNION ALL SELECT 'relation-source_id', source_id FROM rel WHERE source_id NOT IN (SELECT entity_id FROM bad)
UNION ALL SELECT 'relation-target_id', target_id FROM rel WHERE target_id NOT IN (SELECT entity_id FROM bad)""")
def _(t):
    e = t.entities.withColumn("parent_id", F.when(F.col("entity_id") == "floor:7", "building:none").when(F.col("entity_id") == "building:3", "floor:3")
                              .when(F.col("entity_id") == "floor:3", "building:3").otherwise(F.col("parent_id")))
    return h.hierarchy_violations(e.unionByName(t.entities.where("type='zone' and name like '%7'")), relations(t))


EDGES = """nodes AS (SELECT c_custkey AS node_id FROM customer WHERE c_custkey%50<>9), edges AS (SELECT c_custkey AS a, (c_custkey*3+c_nationkey)%(SELECT count(*) FROM customer) AS b FROM customer WHERE c_custkey%3<>0)"""


def graph(t):
    nodes = t.customer.where("c_custkey % 50 <> 9").select(F.col("c_custkey").alias("node_id"))
    edges = t.sql("SELECT c_custkey AS a, (c_custkey*3+c_nationkey)%(SELECT count(*) FROM customer) AS b FROM customer WHERE c_custkey%3<>0")
    return nodes, edges


@query("g11_graph_violations", f"""WITH {EDGES} SELECT 'unknown-a' AS rule, a AS key FROM edges WHERE a NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'unknown-b', b FROM edges WHERE b NOT IN (SELECT node_id FROM nodes) UNION ALL SELECT 'self-loop', a FROM edges WHERE a=b
UNION ALL SELECT 'isolated', node_id FROM nodes WHERE node_id NOT IN (SELECT a FROM edges UNION ALL SELECT b FROM edges)""")
def _(t):
    return h.graph_violations(*graph(t))


@query("d33_neighbours", f"""WITH {EDGES}, u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges) SELECT a AS node_id, b AS neighbour_id FROM u WHERE a IN (SELECT node_id FROM nodes) AND b IN (SELECT node_id FROM nodes)""")
def _(t):
    return h.neighbours(*graph(t))


@query("k3_description_path", """SELECT e.entity_id, CASE e.type WHEN 'campus' THEN 'campus' WHEN 'zone' THEN 'zone · '||p.name WHEN 'building' THEN 'building · '||p.name
 WHEN 'floor' THEN 'floor · '||g.name||' · '||p.name ELSE e.type||' · '||gg.name||' · '||g.name||' · '||p.name END AS description
FROM entities e LEFT JOIN entities p ON p.entity_id=e.parent_id LEFT JOIN entities g ON g.entity_id=p.parent_id LEFT JOIN entities gg ON gg.entity_id=g.parent_id""")
def _(t):
    return h.describe_paths(t.entities)
