"""Ranking and budgeted selection."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.catalogue import mesh as meshq
from landfold.catalogue.scalars import TRIAGE, triage_input
from landfold.operators import mesh as m, scoring, selection as sel
from landfold.plans.greedy import greedy_budget


@query("t1_top_candidates", f"WITH {meshq.comp_sql()}, {meshq.STATS} SELECT {meshq.TIDY} FROM stats WHERE {meshq.GATE} ORDER BY round(stats.area,6), round(stats.gap_p05,6), component LIMIT 20")
def _(t):
    s = meshq.tidy(m.floater_gate(m.component_stats(t.tri, m.components(t.tri), meshq.ground(t))))
    return sel.top_candidates(s, 20)


@query("t2_triage_order", f"WITH {TRIAGE} SELECT id, score FROM sc ORDER BY score DESC, id")
def _(t):
    return sel.triage_order(scoring.triage(triage_input(t))).select("id", "score")


def greedy_sql(name, source, budget, slots, where="TRUE"):
    return f"""{name}_r AS (SELECT scenario, group_id, cost, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, group_id) AS rn FROM {source} WHERE {where}),
{name}_w AS (SELECT scenario, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, 0 AS n, CAST(NULL AS BIGINT) AS group_id, CAST(0 AS BIGINT) AS cost, FALSE AS took FROM (SELECT DISTINCT scenario FROM {source}) s
 UNION ALL SELECT w.scenario, r.rn, CASE WHEN w.used+r.cost<={budget} AND w.n<{slots} THEN w.used+r.cost ELSE w.used END, CASE WHEN w.used+r.cost<={budget} AND w.n<{slots} THEN w.n+1 ELSE w.n END, r.group_id, r.cost, w.used+r.cost<={budget} AND w.n<{slots} FROM {name}_w w JOIN {name}_r r ON r.scenario=w.scenario AND r.rn=w.rn+1)"""


def budgets(t, amount):
    return t.budget_group.select("scenario").distinct().withColumn("budget", F.lit(amount))


@query("t3_greedy_budget", f"WITH RECURSIVE {greedy_sql('g', 'budget_group', 1000, 8)} SELECT scenario, group_id, cost AS paid FROM g_w WHERE took")
def _(t):
    return greedy_budget(t.budget_group.select("scenario", "group_id", "score", "cost"), budgets(t, 1000), slots=8)


@query("t4_greedy_budget_shared", """WITH RECURSIVE r AS (SELECT scenario, group_id, item_id, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, group_id) AS rn FROM budget_group),
w AS (SELECT scenario, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS have, CAST(NULL AS BIGINT) AS group_id, CAST(0 AS BIGINT) AS paid, FALSE AS took FROM (SELECT DISTINCT scenario FROM budget_group) s
 UNION ALL SELECT scenario, rn, CASE WHEN ok THEN used+c ELSE used END, CASE WHEN ok THEN list_distinct(list_concat(have,its)) ELSE have END, group_id, c, ok FROM (SELECT q.*, used+c<=600 AS ok FROM (
  SELECT w.scenario, r.rn, w.used, w.have, r.group_id, [r.item_id,(r.item_id*3+1)%17] AS its, coalesce(CAST(list_sum(list_transform(list_filter(list_distinct([r.item_id,(r.item_id*3+1)%17]), lambda i: NOT list_contains(w.have,i)), lambda i: i*12+40)) AS BIGINT),0) AS c
  FROM w JOIN r ON r.scenario=w.scenario AND r.rn=w.rn+1) q) z)
SELECT scenario, group_id, paid FROM w WHERE took""")
def _(t):
    items = t.budget_group.withColumn("item_id", F.explode(F.array_distinct(F.array("item_id", (F.col("item_id") * 3 + 1) % 17)))).select(
        "scenario", "group_id", "item_id", (F.col("item_id") * 12 + 40).alias("size"))
    return greedy_budget(t.budget_group.select("scenario", "group_id", "score"), budgets(t, 600), items=items)


@query("t6_near_budget", f"""WITH RECURSIVE bg AS (SELECT *, CAST(group_id*37%900 AS DOUBLE) AS distance, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, group_id) AS rk FROM budget_group), {greedy_sql('g', 'bg', 600, 8)},
el AS (SELECT * FROM bg WHERE (scenario, group_id) IN (SELECT (scenario, group_id) FROM g_w WHERE took) OR (rk<=8 AND distance<=300)), {greedy_sql('p', 'el', 1500, 8)}
SELECT w.scenario, w.group_id, w.cost AS paid, b.rk<=8 AND b.distance<=300 AS near FROM p_w w JOIN bg b ON b.scenario=w.scenario AND b.group_id=w.group_id WHERE took""")
def _(t):
    g = t.budget_group.select("scenario", "group_id", "score", "cost", (F.col("group_id") * 37 % 900).cast("double").alias("distance"))
    return sel.near_budget(g, budgets(t, 600), budgets(t, 1500))


@query("t7_choose_level", """WITH d AS (SELECT group_id, CAST(group_id*37%900 AS DOUBLE) AS distance, CAST(group_id*53%700 AS DOUBLE) AS pixels, CAST(group_id%13 AS DOUBLE) AS residual, group_id%3=0 AS wf, group_id%5=0 AS wn, group_id%7<3 AS mf, group_id%11<>0 AS hf, cost FROM budget_group),
e AS (SELECT *, residual*900/(2*tan(radians(5e1)/2)*greatest(2e1,distance)) AS err, distance<=CASE WHEN wf OR wn THEN 330 ELSE 300 END AND pixels>=CASE WHEN wf OR wn THEN 280 ELSE 360 END AS near FROM d),
f AS (SELECT *, mf AND (near OR (distance<=CASE WHEN wf THEN 660 ELSE 600 END AND err>=CASE WHEN wf THEN 15e-1 ELSE 2 END)) AS ex, near AND CASE WHEN wf THEN pixels>=280 AND err>=2 ELSE pixels>=360 AND err>=3 END AS cl, hf AND cost<=400 AS fits FROM e)
SELECT group_id, near, CASE WHEN fits AND (ex OR cl) THEN 'fine' ELSE 'high' END AS level, CASE WHEN fits AND (ex OR cl) THEN CASE WHEN ex THEN 'expanded-near-terminal-range' ELSE 'near-source-error' END WHEN hf AND NOT fits THEN 'whole-terminal-group-exceeds-budget' WHEN hf THEN 'distant-high-frontier' ELSE 'highest-saved-only-level' END AS reason FROM f""")
def _(t):
    k = F.col("group_id")
    d = t.budget_group.select(k, (k * 37 % 900).cast("double").alias("distance"), (k * 53 % 700).cast("double").alias("pixels"), (k % 13).cast("double").alias("residual"), (k % 3 == 0).alias("was_fine"),
                              (k % 5 == 0).alias("was_near"), (k % 7 < 3).alias("mesh_fine"), (k % 11 != 0).alias("has_fine"), F.col("cost").alias("fine_bytes"), F.lit(400).alias("budget"))
    return sel.choose_level(d, 900.0, 50.0).select("group_id", "near", "level", "reason")


CORNERS = ", ".join(f"({i},{i & 1},{i >> 1 & 1},{i >> 2 & 1})" for i in range(8))
SIDES = ", ".join(f"({i},{i | bit})" for i in range(8) for bit in (1, 2, 4) if not i & bit)


@query("t8_view_score", f"""WITH po AS (SELECT line_id AS pose_id, x1 AS ex, 60e0 AS ey, z1 AS ez FROM road_seg WHERE seq=0), bo AS (SELECT poly_id AS box_id, cx-r AS lx, min_y AS ly, cz-r AS lz, cx+r AS hx, max_y AS hy, cz+r AS hz FROM domains),
pr AS (SELECT *, sqrt(pow(greatest(lx-ex,0,ex-hx),2)+pow(greatest(ly-ey,0,ey-hy),2)+pow(greatest(lz-ez,0,ez-hz),2)) AS distance FROM po, bo WHERE ex-400<=hx AND lx<=ex+400 AND ez-400<=hz AND lz<=ez+400),
co AS (SELECT pose_id, box_id, distance, i, CASE WHEN a=1 THEN hx ELSE lx END-ex AS dx, CASE WHEN b=1 THEN hy ELSE ly END-ey AS dy, CASE WHEN c=1 THEN hz ELSE lz END-ez AS dz FROM pr, (VALUES {CORNERS}) k(i,a,b,c)),
ey AS (SELECT pose_id, box_id, distance, i, dx AS x, 8e-1*dy-6e-1*dz AS y, -6e-1*dy-8e-1*dz AS w FROM co),
ed AS (SELECT a.pose_id, a.box_id, a.distance, a.x AS ax, a.y AS ay, a.w AS aw, b.x AS bx, b.y AS "by", b.w AS bw FROM (VALUES {SIDES}) e(p,q) JOIN ey a ON a.i=p JOIN ey b ON b.i=q AND b.pose_id=a.pose_id AND b.box_id=a.box_id),
pt AS (SELECT pose_id, box_id, distance, ax AS x, ay AS y, aw AS w FROM ed WHERE aw>=1 UNION ALL SELECT pose_id, box_id, distance, bx, "by", bw FROM ed WHERE bw>=1
 UNION ALL SELECT pose_id, box_id, distance, ax+(bx-ax)*((1-aw)/(bw-aw)), ay+("by"-ay)*((1-aw)/(bw-aw)), 1e0 FROM ed WHERE (aw>=1)<>(bw>=1)),
m AS (SELECT pose_id, box_id, distance, min(x/w/(tan(radians(25e0))*16e-1)) AS l, max(x/w/(tan(radians(25e0))*16e-1)) AS r, min(y/w/tan(radians(25e0))) AS b, max(y/w/tan(radians(25e0))) AS t FROM pt GROUP BY 1,2,3),
c AS (SELECT pose_id, box_id, distance, CASE WHEN distance=0 THEN -1e0 ELSE greatest(-1e0,least(1e0,l)) END AS l, CASE WHEN distance=0 THEN 1e0 ELSE greatest(-1e0,least(1e0,r)) END AS r, CASE WHEN distance=0 THEN -1e0 ELSE greatest(-1e0,least(1e0,b)) END AS b, CASE WHEN distance=0 THEN 1e0 ELSE greatest(-1e0,least(1e0,t)) END AS t FROM m),
z AS (SELECT pose_id, box_id, distance, (r-l)*900*16e-1/2 AS wp, (t-b)*900e0/2 AS hp, (l+r)/2 AS cx, (b+t)/2 AS cy FROM c WHERE r>l AND t>b)
SELECT pose_id, box_id, round(greatest(wp,hp),6) AS pixels, round(distance,6) AS distance, round(sqrt(wp*hp)*(22e-2+78e-2*exp(-28e-1*(cx*cx+cy*cy)))/(1+distance/800),6) AS score FROM z WHERE greatest(wp,hp)>=48""")
def _(t):
    poses = t.road_seg.where("seq = 0").select(
        F.col("line_id").alias("pose_id"), F.col("x1").alias("ex"), F.lit(60.0).alias("ey"), F.col("z1").alias("ez"),
        *[F.lit(float(v)).alias(n) for n, v in zip(("rx", "ry", "rz", "ux", "uy", "uz", "fx", "fy", "fz"), (1, 0, 0, 0, 0.8, -0.6, 0, -0.6, -0.8))])
    boxes = t.domains.select(F.col("poly_id").alias("box_id"), (F.col("cx") - F.col("r")).alias("min_x"), F.col("min_y"), (F.col("cz") - F.col("r")).alias("min_z"),
                             (F.col("cx") + F.col("r")).alias("max_x"), F.col("max_y"), (F.col("cz") + F.col("r")).alias("max_z"))
    s = sel.view_score(poses, boxes, 900.0, 1.6, 50.0, reach=400.0)
    return s.withColumns({c: F.round(c, 6) for c in ("pixels", "distance", "score")})


@query("t10_cap", "WITH k AS (SELECT o_custkey AS key, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT key, id, pos, greatest(0,n-6) AS more FROM k WHERE pos<=6")
def _(t):
    df = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return sel.cap(df, "key", [F.col("o_totalprice").desc(), "id"], 6).drop("o_totalprice")


@query("c12_exclude_status", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'not-yet-built' WHEN 'F' THEN 'demolished' END AS excluded FROM orders")
def _(t):
    return sel.exclude_status(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), {"P": "not-yet-built", "F": "demolished"}).drop("status")


@query("d24_connect_ends", """WITH e AS (SELECT line_id, x1 AS x, z1 AS z FROM road_seg WHERE seq=0 UNION ALL SELECT line_id, x2, z2 FROM road_seg WHERE seq=1) SELECT DISTINCT a.line_id AS a, b.line_id AS b FROM e a JOIN e b ON a.line_id<b.line_id AND abs(a.x-b.x)<=6 AND abs(a.z-b.z)<=6 WHERE pow(a.x-b.x,2)+pow(a.z-b.z,2)<=36""")
def _(t):
    a = t.road_seg.where("seq=0").select("line_id", F.col("x1").alias("sx"), F.col("z1").alias("sz"))
    b = t.road_seg.where("seq=1").select("line_id", F.col("x2").alias("ex"), F.col("z2").alias("ez"))
    return sel.connect_ends(a.join(b, "line_id"), 6.0)


@query("d11_tiles_for_domains", """WITH tb AS (SELECT tri_idx AS tile_id, least(x1,x2,x3) AS x0, greatest(x1,x2,x3) AS xx, least(z1,z2,z3) AS z0, greatest(z1,z2,z3) AS zz FROM tri) SELECT poly_id, tile_id FROM domains d JOIN tb ON cx-r-10<=xx AND x0<=cx+r+10 AND cz-r-10<=zz AND z0<=cz+r+10""")
def _(t):
    dom = t.domains.select("poly_id", *[(F.col(c) + s * F.col("r")).alias(n) for n, c, s in (("min_x", "cx", -1), ("min_z", "cz", -1), ("max_x", "cx", 1), ("max_z", "cz", 1))])
    tiles = t.tri.select(F.col("tri_idx").alias("tile_id"), *[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"{n}_{a}") for n, f in (("min", F.least), ("max", F.greatest)) for a in "xz"])
    return sel.tiles_for_domains(dom, tiles, 10.0)


#: ranked groups of a scenario with the box of their mask; every seventh has none
CHOICE = """SELECT scenario, group_id, score, group_id%19=0 AS protected, group_id%4=1 AS near, group_id%3<>0 AS wants_fine, cost AS high_cost, cost*2+group_id%7 AS fine_cost,
    CASE WHEN group_id%7<>2 THEN group_id*13%40 END AS x0, CASE WHEN group_id%7<>2 THEN group_id*29%30 END AS z0, CASE WHEN group_id%7<>2 THEN group_id*13%40+group_id%5+1 END AS x1, CASE WHEN group_id%7<>2 THEN group_id*29%30+group_id%4+1 END AS z1 FROM budget_group"""
BUDGET, MASKS, IN_USE = 9000, 14, 300


def walk_sql(name: str, start: str, cand: str) -> str:
    """One tier as a walk by rank: at each step the set's price with the next group, at its cost and at its fallback."""
    box = ", ".join(f"{f}(w.{c}, c.{c}) AS n{c}" for c, f in (("x0", "least"), ("z0", "least"), ("x1", "greatest"), ("z1", "greatest")))
    return f"""{name}_c AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, group_id) AS rn FROM ({cand}) q),
{name} AS (SELECT scenario, CAST(0 AS BIGINT) AS i, spent, masks, x0, z0, x1, z1, CAST(NULL AS BIGINT) AS group_id, CAST(NULL AS BIGINT) AS paid FROM {start}
 UNION ALL SELECT scenario, i+1, CASE WHEN pay IS NULL THEN spent ELSE spent+pay END, CASE WHEN pay IS NULL THEN masks ELSE nm END, CASE WHEN pay IS NULL THEN x0 ELSE nx0 END, CASE WHEN pay IS NULL THEN z0 ELSE nz0 END,
  CASE WHEN pay IS NULL THEN x1 ELSE nx1 END, CASE WHEN pay IS NULL THEN z1 ELSE nz1 END, gid, pay
  FROM (SELECT *, CASE WHEN nm>{MASKS} THEN NULL WHEN spent+cost+u+greatest(u,{IN_USE})<={BUDGET} THEN cost WHEN spent+fallback+u+greatest(u,{IN_USE})<={BUDGET} THEN fallback END AS pay
   FROM (SELECT *, CASE WHEN nm=0 THEN 1 ELSE (nx1-nx0)*(nz1-nz0) END AS u FROM (SELECT w.*, c.group_id AS gid, c.cost, c.fallback, w.masks+CASE WHEN c.x0 IS NULL THEN 0 ELSE 1 END AS nm, {box} FROM {name} w JOIN {name}_c c ON c.scenario=w.scenario AND c.rn=w.i+1) q0) q1) q2),
{name}_s AS (SELECT scenario, arg_max(struct_pack(a := spent, b := masks, c := x0, d := z0, e := x1, f := z1), i) AS s FROM {name} GROUP BY 1),
{name}_e AS (SELECT scenario, s.a AS spent, s.b AS masks, s.c AS x0, s.d AS z0, s.e AS x1, s.f AS z1 FROM {name}_s), {name}_w AS (SELECT scenario, group_id, paid FROM {name} WHERE paid IS NOT NULL)"""


NONE = "CAST(NULL AS BIGINT)"
IDS = "scenario, group_id, score"
TIERS = f"""ch AS ({CHOICE}), s0 AS (SELECT DISTINCT scenario, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS masks, {NONE} AS x0, {NONE} AS z0, {NONE} AS x1, {NONE} AS z1 FROM ch),
{walk_sql("t1", "s0", f"SELECT {IDS}, fine_cost AS cost, {NONE} AS fallback, x0, z0, x1, z1 FROM ch WHERE protected")},
{walk_sql("t2", "t1_e", f"SELECT {IDS}, high_cost AS cost, {NONE} AS fallback, x0, z0, x1, z1 FROM ch WHERE near AND group_id NOT IN (SELECT group_id FROM t1_w)")},
{walk_sql("t3", "t2_e", f"SELECT {IDS}, fine_cost-high_cost AS cost, {NONE} AS fallback, {NONE} AS x0, {NONE} AS z0, {NONE} AS x1, {NONE} AS z1 FROM ch WHERE wants_fine AND group_id IN (SELECT group_id FROM t2_w)")},
um AS (SELECT DISTINCT scenario FROM ch WHERE near AND group_id NOT IN (SELECT group_id FROM t1_w) AND (group_id NOT IN (SELECT group_id FROM t2_w) OR (wants_fine AND group_id NOT IN (SELECT group_id FROM t3_w)))),
rs AS (SELECT *, NOT wants_fine OR (NOT near AND scenario IN (SELECT scenario FROM um)) AS plain FROM ch WHERE group_id NOT IN (SELECT group_id FROM t1_w) AND group_id NOT IN (SELECT group_id FROM t2_w)),
{walk_sql("t4", "t3_e", f"SELECT {IDS}, CASE WHEN plain THEN high_cost ELSE fine_cost END AS cost, CASE WHEN NOT plain THEN high_cost END AS fallback, x0, z0, x1, z1 FROM rs")},
new AS (SELECT scenario, group_id, paid, 'fine' AS level, 'protected' AS tier FROM t1_w UNION ALL SELECT n.scenario, n.group_id, n.paid+coalesce(u.paid,0), CASE WHEN u.paid IS NULL THEN 'high' ELSE 'fine' END, 'near' FROM t2_w n LEFT JOIN t3_w u ON u.scenario=n.scenario AND u.group_id=n.group_id
 UNION ALL SELECT w.scenario, w.group_id, w.paid, CASE WHEN NOT r.plain AND w.paid=r.fine_cost THEN 'fine' ELSE 'high' END, 'distant' FROM t4_w w JOIN rs r ON r.scenario=w.scenario AND r.group_id=w.group_id)"""


def limits(t):
    return budgets(t, BUDGET).withColumn("current", F.lit(IN_USE))


@query("t5_tiered_budget", f"WITH RECURSIVE {TIERS} SELECT scenario, group_id, paid, level, tier FROM new")
def _(t):
    return sel.tiered_budget(t.sql(CHOICE), limits(t), MASKS)


@query("t11_policy_replay", f"""WITH RECURSIVE {TIERS}, oc AS (SELECT scenario, group_id, CASE WHEN wants_fine THEN fine_cost ELSE high_cost END AS cost, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, group_id) AS rn FROM ch),
ow AS (SELECT DISTINCT scenario, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS spent, {NONE} AS paid FROM ch UNION ALL SELECT w.scenario, w.i+1, w.spent+CASE WHEN w.spent+c.cost<={BUDGET} THEN c.cost ELSE 0 END, CASE WHEN w.spent+c.cost<={BUDGET} THEN c.cost END FROM ow w JOIN oc c ON c.scenario=w.scenario AND c.rn=w.i+1),
o AS (SELECT scenario, count(*) AS g, CAST(sum(paid) AS BIGINT) AS b FROM ow WHERE paid IS NOT NULL GROUP BY 1), n AS (SELECT scenario, count(*) AS g, CAST(sum(paid) AS BIGINT) AS b FROM new GROUP BY 1)
SELECT coalesce(o.scenario, n.scenario) AS scenario, o.g AS old_groups, o.b AS old_bytes, n.g AS new_groups, n.b AS new_bytes FROM o FULL JOIN n ON n.scenario=o.scenario""")
def _(t):
    return sel.policy_replay(t.sql(CHOICE), limits(t), MASKS)
