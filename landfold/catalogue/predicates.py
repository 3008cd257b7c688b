"""Pairwise predicates and segment-volume occlusion."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.functions import geometry as g
from landfold.operators import occlusion
from landfold.plans.gridjoin import box_pairs


@query("c1_aabb_overlaps", "SELECT a.poly_id AS a, b.poly_id AS b, a.min_y<=b.max_y AND b.min_y<=a.max_y AS in_3d FROM domains a JOIN domains b ON a.poly_id<b.poly_id AND a.cx-a.r<=b.cx+b.r AND b.cx-b.r<=a.cx+a.r AND a.cz-a.r<=b.cz+b.r AND b.cz-b.r<=a.cz+a.r")
def _(t):
    def box(p, n):
        return t.domains.select(F.col("poly_id").alias(n), F.col("min_y").alias(f"{n}y0"), F.col("max_y").alias(f"{n}y1"),
                                *[(F.col(c) + s * F.col("r")).alias(f"{n}{k}") for k, c, s in (("x0", "cx", -1), ("z0", "cz", -1), ("x1", "cx", 1), ("z1", "cz", 1))])

    pairs = box_pairs(box(t, "a"), box(t, "b")).where("a < b")
    return pairs.select("a", "b", g.aabb_overlaps(["ax0", "ay0", "az0", "ax1", "ay1", "az1"], ["bx0", "by0", "bz0", "bx1", "by1", "bz1"]).alias("in_3d"))


@query("c4_seg_intersects", """WITH p AS (SELECT a.line_id AS a, a.seq AS sa, b.line_id AS b, b.seq AS sb, (a.x2-a.x1)*(b.z1-a.z1)-(a.z2-a.z1)*(b.x1-a.x1) AS o1, (a.x2-a.x1)*(b.z2-a.z1)-(a.z2-a.z1)*(b.x2-a.x1) AS o2, (b.x2-b.x1)*(a.z1-b.z1)-(b.z2-b.z1)*(a.x1-b.x1) AS o3, (b.x2-b.x1)*(a.z2-b.z1)-(b.z2-b.z1)*(a.x2-b.x1) AS o4,
 b.x1 BETWEEN least(a.x1,a.x2) AND greatest(a.x1,a.x2) AND b.z1 BETWEEN least(a.z1,a.z2) AND greatest(a.z1,a.z2) AS i1, b.x2 BETWEEN least(a.x1,a.x2) AND greatest(a.x1,a.x2) AND b.z2 BETWEEN least(a.z1,a.z2) AND greatest(a.z1,a.z2) AS i2,
 a.x1 BETWEEN least(b.x1,b.x2) AND greatest(b.x1,b.x2) AND a.z1 BETWEEN least(b.z1,b.z2) AND greatest(b.z1,b.z2) AS i3, a.x2 BETWEEN least(b.x1,b.x2) AND greatest(b.x1,b.x2) AND a.z2 BETWEEN least(b.z1,b.z2) AND greatest(b.z1,b.z2) AS i4
 FROM road_seg a JOIN road_seg b ON a.line_id<b.line_id AND least(a.x1,a.x2)<=greatest(b.x1,b.x2) AND least(b.x1,b.x2)<=greatest(a.x1,a.x2) AND least(a.z1,a.z2)<=greatest(b.z1,b.z2) AND least(b.z1,b.z2)<=greatest(a.z1,a.z2))
SELECT a, sa, b, sb FROM p WHERE (sign(o1)*sign(o2)<0 AND sign(o3)*sign(o4)<0) OR (o1=0 AND i1) OR (o2=0 AND i2) OR (o3=0 AND i3) OR (o4=0 AND i4)""")
def _(t):
    def side(n):
        s = t.road_seg.select(F.col("line_id").alias(n), F.col("seq").alias(f"s{n}"), *[F.col(c).alias(f"{n}_{c}") for c in ("x1", "z1", "x2", "z2")])
        return s.withColumns({f"{n}{a}{i}": f(f"{n}_{a}1", f"{n}_{a}2") for a in "xz" for i, f in ((0, F.least), (1, F.greatest))})

    seg = [[f"{n}_{c}" for c in ("x1", "z1", "x2", "z2")] for n in "ab"]
    return box_pairs(side("a"), side("b")).where("a < b").where(g.seg_intersects(*seg)).select("a", "sa", "b", "sb")


VIEWS = """sight AS (SELECT c_custkey AS pair_id, ((c_custkey*137+c_nationkey*11)%(4*(SELECT w FROM world)))/4e0 AS cx, 15e0+c_custkey%40 AS cy, ((c_custkey*53+c_nationkey*171)%(4*(SELECT w FROM world)))/4e0 AS cz, c_custkey%41-20 AS dx, c_custkey%37-18 AS dz FROM customer),
prs AS (SELECT pair_id, cx, cy, cz, cx+dx*4e0 AS mx, 20e0 AS my, cz+dz*4e0 AS mz, pair_id%100 AS own FROM sight)"""


def sight(t):
    s = t.sql("""SELECT c_custkey AS pair_id, ((c_custkey*137+c_nationkey*11)%(4*(SELECT w FROM world)))/4e0 AS cx, 15e0+c_custkey%40 AS cy, ((c_custkey*53+c_nationkey*171)%(4*(SELECT w FROM world)))/4e0 AS cz,
        c_custkey%41-20 AS dx, c_custkey%37-18 AS dz FROM customer""")
    return s.select("pair_id", "cx", "cy", "cz", (F.col("cx") + F.col("dx") * 4.0).alias("mx"), F.lit(20.0).alias("my"), (F.col("cz") + F.col("dz") * 4.0).alias("mz"), (F.col("pair_id") % 100).alias("own_id"))


OCC = f"""{VIEWS}, bx AS (SELECT e.poly_id, min(x1) AS x0, max(x1) AS x9, min(z1) AS z0, max(z1) AS z9, max(d.min_y) AS y0, max(d.max_y) AS y9 FROM poly_edge e JOIN domains d ON d.poly_id=e.poly_id WHERE ring=0 GROUP BY 1),
cn AS (SELECT p.*, b.poly_id, mx-cx AS vx, my-cy AS vy, mz-cz AS vz,
 greatest(0e0, CASE WHEN abs(mx-cx)<=1e-7 THEN 0e0 ELSE least((x0-cx)/nullif(mx-cx,0),(x9-cx)/nullif(mx-cx,0)) END, CASE WHEN abs(my-cy)<=1e-7 THEN 0e0 ELSE least((y0-cy)/nullif(my-cy,0),(y9-cy)/nullif(my-cy,0)) END, CASE WHEN abs(mz-cz)<=1e-7 THEN 0e0 ELSE least((z0-cz)/nullif(mz-cz,0),(z9-cz)/nullif(mz-cz,0)) END) AS t0,
 least(1e0, CASE WHEN abs(mx-cx)<=1e-7 THEN 1e0 ELSE greatest((x0-cx)/nullif(mx-cx,0),(x9-cx)/nullif(mx-cx,0)) END, CASE WHEN abs(my-cy)<=1e-7 THEN 1e0 ELSE greatest((y0-cy)/nullif(my-cy,0),(y9-cy)/nullif(my-cy,0)) END, CASE WHEN abs(mz-cz)<=1e-7 THEN 1e0 ELSE greatest((z0-cz)/nullif(mz-cz,0),(z9-cz)/nullif(mz-cz,0)) END) AS t1
 FROM prs p JOIN bx b ON b.poly_id<>p.own AND NOT (abs(mx-cx)<=1e-7 AND (cx<=x0+1e-7 OR cx>=x9-1e-7)) AND NOT (abs(my-cy)<=1e-7 AND (cy<=y0+1e-7 OR cy>=y9-1e-7)) AND NOT (abs(mz-cz)<=1e-7 AND (cz<=z0+1e-7 OR cz>=z9-1e-7))),
c2 AS (SELECT * FROM cn WHERE t1-t0>1e-7),
cr AS (SELECT c.pair_id, c.poly_id, t0, t1, ((x1-cx)*(z2-z1)-(z1-cz)*(x2-x1))/nullif(vx*(z2-z1)-vz*(x2-x1),0) AS t, ((x1-cx)*vz-(z1-cz)*vx)/nullif(vx*(z2-z1)-vz*(x2-x1),0) AS u, abs(vx*(z2-z1)-vz*(x2-x1)) AS den FROM c2 c JOIN poly_edge e ON e.poly_id=c.poly_id),
ct AS (SELECT pair_id, poly_id, t0 AS t FROM c2 UNION SELECT pair_id, poly_id, t1 FROM c2 UNION SELECT pair_id, poly_id, t FROM cr WHERE den>1e-7 AND t>t0 AND t<t1 AND u>=-1e-7 AND u<=1+1e-7),
md AS (SELECT pair_id, poly_id, t, lead(t) OVER (PARTITION BY pair_id, poly_id ORDER BY t) AS nt FROM ct),
mp AS (SELECT m.pair_id*100000+m.poly_id AS pt_id, m.pair_id, m.poly_id AS want, cx+(mx-cx)*(m.t+nt)/2 AS x, cz+(mz-cz)*(m.t+nt)/2 AS z, m.t FROM md m JOIN prs p ON p.pair_id=m.pair_id WHERE nt-m.t>1e-7),
ins AS (SELECT m.pair_id, m.want, m.t, e.ring, sum(CASE WHEN ((e.z1>m.z)<>(e.z2>m.z)) AND m.x < (e.x2-e.x1)*(m.z-e.z1)/nullif(e.z2-e.z1,0)+e.x1 THEN 1 ELSE 0 END)%2=1 AS odd, max(abs((m.x-e.x1)*(e.z2-e.z1)-(m.z-e.z1)*(e.x2-e.x1)) <= 1e-7*greatest(1e0,abs(e.x2-e.x1)+abs(e.z2-e.z1)) AND m.x BETWEEN least(e.x1,e.x2)-1e-7 AND greatest(e.x1,e.x2)+1e-7 AND m.z BETWEEN least(e.z1,e.z2)-1e-7 AND greatest(e.z1,e.z2)+1e-7) AS touch FROM mp m JOIN poly_edge e ON e.poly_id=m.want GROUP BY 1,2,3,4),
occ AS (SELECT DISTINCT pair_id FROM (SELECT pair_id, want, t FROM ins GROUP BY 1,2,3 HAVING max(ring=0 AND odd AND NOT touch) AND NOT max(ring>0 AND (odd OR touch))) z)"""


@query("d9_occluded_pairs", f"WITH {OCC} SELECT pair_id FROM occ")
def _(t):
    return occlusion.occluded(sight(t), t.poly_edge, t.domains).select("pair_id")


@query("k18_label_visibility", f"WITH {OCC} SELECT p.pair_id, o.pair_id IS NULL AS visible FROM prs p LEFT JOIN occ o ON o.pair_id=p.pair_id")
def _(t):
    return occlusion.label_visibility(sight(t), t.poly_edge, t.domains)
