"""Counts, roll-ups, registrations and costs."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.operators import scoring, summaries as s


@query("e1_category_counts", "SELECT CASE WHEN type='campus' THEN 'other' ELSE type END AS category, count(*) AS n FROM entities GROUP BY 1")
def _(t):
    none = F.lit(None).cast("string")
    twice = t.entities.unionByName(t.entities.where("type='floor'"))
    return s.category_counts(twice, scoring.classify("type", none, F.array().cast("array<string>")))


@query("e2_registry_counts", "SELECT type, count(*) AS n FROM entities GROUP BY ROLLUP(type)")
def _(t):
    return s.registry_counts(t.entities)


@query("e3_group_lines", """SELECT o_custkey AS code, o_orderkey AS line_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, count(*) OVER (PARTITION BY o_custkey) AS lines, min(o_orderstatus) OVER (PARTITION BY o_custkey)=max(o_orderstatus) OVER (PARTITION BY o_custkey) AS consistent FROM orders""")
def _(t):
    return s.group_lines(t.orders.select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("line_id"), F.col("o_orderstatus").alias("name")), "code", "name", "line_id").drop("name")


@query("e4_bounds_union", "SELECT tile_id, min(least(x1,x2,x3)) AS min_x, min(least(y1,y2,y3)) AS min_y, min(least(z1,z2,z3)) AS min_z, max(greatest(x1,x2,x3)) AS max_x, max(greatest(y1,y2,y3)) AS max_y, max(greatest(z1,z2,z3)) AS max_z FROM tri GROUP BY 1")
def _(t):
    b = t.tri.select("tile_id", *[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"{n}_{a}") for n, f in (("min", F.least), ("max", F.greatest)) for a in "xyz"])
    return s.bounds_union(b, "tile_id")


@query("e24_floor_z", """WITH n AS (SELECT o_custkey AS floor_id, CAST(o_orderkey%4*(o_custkey%3) AS DOUBLE) AS z, count(*) AS n FROM orders GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY floor_id ORDER BY n DESC, z) AS rn, count(*) OVER (PARTITION BY floor_id) AS values FROM n)
SELECT floor_id, z AS mode, values, CASE WHEN values=1 THEN z END AS single FROM k WHERE rn=1""")
def _(t):
    rooms = t.orders.select(F.col("o_custkey").alias("floor_id"), (F.col("o_orderkey") % 4 * (F.col("o_custkey") % 3)).cast("double").alias("z"))
    return s.modal_value(rooms, "floor_id", "z")


FIT = """c0 AS (SELECT o_custkey%40 AS k, (o_orderkey%311)*1e0 AS x, (o_orderkey*7%293)*1e0 AS y, 2e0*(o_orderkey%311)-5e-1*(o_orderkey*7%293)+30+o_orderkey%5 AS e, (o_orderkey%311)+3e0*(o_orderkey*7%293)-9+o_custkey%7 AS n FROM orders),
c1 AS (SELECT k, x-avg(x) OVER w AS x, y-avg(y) OVER w AS y, e-avg(e) OVER w AS e, n-avg(n) OVER w AS n, count(*) OVER w AS c FROM c0 WINDOW w AS (PARTITION BY k)),
m AS (SELECT k, sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, sum(x*e) AS xe, sum(y*e) AS ye, sum(x*n) AS xn, sum(y*n) AS yn, sum(x*x)*sum(y*y)-sum(x*y)*sum(x*y) AS det FROM c1 GROUP BY k),
co AS (SELECT *, (xe*yy-ye*xy)/det AS ae, (ye*xx-xe*xy)/det AS be, (xn*yy-yn*xy)/det AS an, (yn*xx-xn*xy)/det AS bn FROM m),
r AS (SELECT c1.k, ae, be, an, bn, pow(e-ae*x-be*y,2)+pow(n-an*x-bn*y,2) AS sq, 1e0/c+(yy*x*x-2*xy*x*y+xx*y*y)/det AS h FROM c1 JOIN co ON co.k=c1.k)"""


@query("e25_fit_affine", f"WITH {FIT} SELECT k, count(*) AS controls, round(max(ae),6) AS ae, round(max(be),6) AS be, round(max(an),6) AS an, round(max(bn),6) AS bn, round(sqrt(avg(sq)),6) AS rmse, round(sqrt(avg(pow(sqrt(sq)/(1-h),2))),6) AS loo_rmse, round(max(sqrt(sq)/(1-h)),6) AS loo_max FROM r GROUP BY k")
def _(t):
    return rounded(s.fit_affine(controls(t), "k"), "ae", "be", "an", "bn", "rmse", "loo_rmse", "loo_max")


def controls(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (k % 311).cast("double"), (k * 7 % 293).cast("double")
    return t.orders.select((c % 40).alias("k"), x.alias("x"), y.alias("y"), (x * 2 - y * 0.5 + 30 + k % 5).alias("e"), (x + y * 3 - 9 + c % 7).alias("n"))


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("e26_fit_plane")
def _(t):
    k = F.col("pt_id") % 20
    y = F.col("x") * 0.1 - F.col("z") * 0.05 + k + F.when(F.col("pt_id") % 5 == 0, F.col("y")).otherwise((F.col("pt_id") % 3) * 0.05)
    return rounded(s.fit_plane(t.pts.select(k.alias("segment"), "x", y.alias("y"), "z"), "segment"), "a", "b", "c", "rms")


@query("e27_payload_compare", """WITH p AS (SELECT l_suppkey AS owner, sum(CASE WHEN l_linenumber%2=0 THEN l_orderkey END) AS h, sum(CASE WHEN l_linenumber%2=1 AND l_suppkey%9<>0 THEN l_orderkey END) AS f FROM lineitem WHERE l_suppkey%9<>0 OR l_linenumber%2=0 GROUP BY 1)
SELECT owner, CAST(h AS BIGINT) AS high_bytes, CAST(f AS BIGINT) AS fine_bytes, round(CAST(f AS DOUBLE)/nullif(CAST(h AS DOUBLE),0),4) AS bytes_ratio, CAST(f-h AS BIGINT) AS bytes_gain FROM p""")
def _(t):
    tiles = t.lineitem.where("l_suppkey%9<>0 or l_linenumber%2=0").select(F.col("l_suppkey").alias("owner"), F.when(F.col("l_linenumber") % 2 == 0, "high").otherwise("fine").alias("level"), F.col("l_orderkey").alias("bytes"))
    return s.payload_compare(tiles, "owner", ["bytes"])


@query("e31_qa_sample", "SELECT * FROM pts ORDER BY sha256(concat('20250327|', CAST(pt_id AS VARCHAR))), pt_id LIMIT 2500")
def _(t):
    return s.qa_sample(t.pts, 2500, 20250327, "pt_id")


@query("e32_count_bounds", "SELECT count(CASE WHEN s_suppkey%4<>0 THEN 1 END) AS lower_bound, CAST(sum(CASE WHEN s_suppkey%4=0 THEN 0 WHEN s_suppkey%5=1 THEN greatest(1,s_suppkey%7) ELSE 1 END) AS BIGINT) AS upper_bound, count(*) AS domains FROM supplier")
def _(t):
    k = F.col("s_suppkey")
    return s.count_bounds(t.supplier.select((k % 4 != 0).alias("verified"), (k % 5 == 1).alias("unsplit"), (k % 7).alias("members")))


@query("e33_unique_content", "SELECT count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(n-1) AS BIGINT) AS duplicates FROM (SELECT sha256, max(bytes) AS b, count(*) AS n FROM (SELECT * FROM inv_a UNION ALL SELECT * FROM inv_b) q GROUP BY 1) u")
def _(t):
    return s.unique_content(t.inv_a.unionByName(t.inv_b))


@query("e35_set_cost", """WITH i AS (SELECT p_partkey%15 AS set_id, p_size AS w, p_size*2 AS h FROM part), mb AS (SELECT set_id, sum(4*greatest(1,CAST(floor(w/pow(2,k)) AS BIGINT))*greatest(1,CAST(floor(h/pow(2,k)) AS BIGINT))) AS b FROM i, range(0,14) q(k) WHERE k<=floor(log2(greatest(w,h))) GROUP BY 1),
ms AS (SELECT DISTINCT poly_id%15 AS set_id, poly_id%30 AS url, CAST(poly_id%30+4 AS BIGINT) AS w, CAST(0 AS DOUBLE)+(poly_id%30)*3 AS x0, (poly_id%30)*3+(poly_id%30+4)*5e-1 AS x1 FROM domains), mc AS (SELECT set_id, sum(w*w*4)+CAST(ceil((max(x1)-min(x0))/5e-1) AS BIGINT)*CAST(ceil((max(x1)-min(x0))/5e-1) AS BIGINT)*8 AS b FROM ms GROUP BY 1)
SELECT coalesce(mb.set_id,mc.set_id) AS set_id, CAST(coalesce(mb.b,0)+coalesce(mc.b,0)+1000 AS BIGINT) AS bytes FROM mb FULL JOIN mc ON mc.set_id=mb.set_id""")
def _(t):
    images = t.part.select((F.col("p_partkey") % 15).alias("set_id"), F.col("p_size").alias("width"), (F.col("p_size") * 2).alias("height"))
    u = F.col("poly_id") % 30
    lo, hi = (u * 3).cast("double"), u * 3 + (u + 4) * 0.5
    masks = t.domains.select((F.col("poly_id") % 15).alias("set_id"), u.alias("url"), (u + 4).alias("width"), (u + 4).alias("height"), F.lit(0.5).alias("pixel"),
                             lo.alias("min_x"), lo.alias("min_z"), hi.alias("max_x"), hi.alias("max_z"))
    return s.set_cost(images, masks, "set_id", 1000)
