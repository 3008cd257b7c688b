"""Point, polygon and line joins."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.functions.geometry import seg_dist
from landfold.operators import attribution, polygons

# The brute-force twin of the slab join: every point in a polygon's box against all its edges.
RINGS = """
 boxes AS (SELECT poly_id, min(x1)-{pad} AS bx0, max(x1)+{pad} AS bx1, min(z1)-{pad} AS bz0, max(z1)+{pad} AS bz1 FROM {edges} WHERE ring=0 GROUP BY poly_id),
 rings AS (SELECT p.pt_id, e.poly_id, e.ring,
   sum(CASE WHEN ((e.z1>p.z)<>(e.z2>p.z)) AND p.x < (e.x2-e.x1)*(p.z-e.z1)/nullif(e.z2-e.z1,0)+e.x1 THEN 1 ELSE 0 END)%2=1 AS odd,
   max(abs((p.x-e.x1)*(e.z2-e.z1)-(p.z-e.z1)*(e.x2-e.x1)) <= 1e-7*greatest(1e0,abs(e.x2-e.x1)+abs(e.z2-e.z1))
       AND p.x BETWEEN least(e.x1,e.x2)-1e-7 AND greatest(e.x1,e.x2)+1e-7 AND p.z BETWEEN least(e.z1,e.z2)-1e-7 AND greatest(e.z1,e.z2)+1e-7) AS touch,
   min(pow(p.x-e.x1-greatest(0e0,least(1e0,((p.x-e.x1)*(e.x2-e.x1)+(p.z-e.z1)*(e.z2-e.z1))/((e.x2-e.x1)*(e.x2-e.x1)+(e.z2-e.z1)*(e.z2-e.z1))))*(e.x2-e.x1),2)
      +pow(p.z-e.z1-greatest(0e0,least(1e0,((p.x-e.x1)*(e.x2-e.x1)+(p.z-e.z1)*(e.z2-e.z1))/((e.x2-e.x1)*(e.x2-e.x1)+(e.z2-e.z1)*(e.z2-e.z1))))*(e.z2-e.z1),2)) AS d2
  FROM {points} p JOIN boxes b ON p.x BETWEEN b.bx0 AND b.bx1 AND p.z BETWEEN b.bz0 AND b.bz1 JOIN {edges} e ON e.poly_id=b.poly_id
  GROUP BY p.pt_id, e.poly_id, e.ring)"""
FOLDS = {
    "exclude": "max(ring=0 AND odd AND NOT touch) AND NOT max(ring>0 AND (odd OR touch))",
    "include_outer": "max(ring=0 AND (odd OR d2<=1e-8)) AND NOT max(ring>0 AND (odd OR d2<=1e-8))",
    "include_all": "max(ring=0 AND (odd OR d2<=1e-8)) AND NOT max(ring>0 AND odd AND d2>1e-8)",
}


def rings_sql(pad="1e-4", points="pts", edges="poly_edge"):
    return RINGS.format(pad=pad, points=points, edges=edges)


def inside_sql(mode="include_outer", name="inside", **kw):
    return f"{rings_sql(**kw)}, {name} AS (SELECT pt_id, poly_id FROM rings GROUP BY pt_id, poly_id HAVING {FOLDS[mode]})"


for _id, _mode in (("c2a_pip_strict", "exclude"), ("c2b_pip_outline", "include_outer"), ("c2c_pip_all_boundaries", "include_all")):
    query(_id, f"WITH {inside_sql(_mode)} SELECT pt_id, poly_id FROM inside")(
        lambda t, mode=_mode: polygons.point_in_polygon(t.pts, t.poly_edge, mode)
    )


@query("c5_poly_intersects", """
WITH v AS (SELECT poly_id, min(x1) AS x0, max(x1) AS xx, min(z1) AS z0, max(z1) AS zz FROM poly_edge WHERE ring=0 GROUP BY 1),
cand AS (SELECT a.poly_id AS a_id, b.poly_id AS b_id FROM v a JOIN v b ON a.poly_id<b.poly_id AND a.x0<=b.xx AND b.x0<=a.xx AND a.z0<=b.zz AND b.z0<=a.zz),
ee AS (SELECT c.a_id, c.b_id,
  (a.x2-a.x1)*(b.z1-a.z1)-(a.z2-a.z1)*(b.x1-a.x1) AS o1, (a.x2-a.x1)*(b.z2-a.z1)-(a.z2-a.z1)*(b.x2-a.x1) AS o2,
  (b.x2-b.x1)*(a.z1-b.z1)-(b.z2-b.z1)*(a.x1-b.x1) AS o3, (b.x2-b.x1)*(a.z2-b.z1)-(b.z2-b.z1)*(a.x2-b.x1) AS o4,
  b.x1 BETWEEN least(a.x1,a.x2) AND greatest(a.x1,a.x2) AND b.z1 BETWEEN least(a.z1,a.z2) AND greatest(a.z1,a.z2) AS i1,
  b.x2 BETWEEN least(a.x1,a.x2) AND greatest(a.x1,a.x2) AND b.z2 BETWEEN least(a.z1,a.z2) AND greatest(a.z1,a.z2) AS i2,
  a.x1 BETWEEN least(b.x1,b.x2) AND greatest(b.x1,b.x2) AND a.z1 BETWEEN least(b.z1,b.z2) AND greatest(b.z1,b.z2) AS i3,
  a.x2 BETWEEN least(b.x1,b.x2) AND greatest(b.x1,b.x2) AND a.z2 BETWEEN least(b.z1,b.z2) AND greatest(b.z1,b.z2) AS i4
  FROM cand c JOIN poly_edge a ON a.poly_id=c.a_id JOIN poly_edge b ON b.poly_id=c.b_id),
cut AS (SELECT DISTINCT a_id, b_id FROM ee WHERE (sign(o1)*sign(o2)<0 AND sign(o3)*sign(o4)<0) OR (o1=0 AND i1) OR (o2=0 AND i2) OR (o3=0 AND i3) OR (o4=0 AND i4)),
firsts AS (SELECT poly_id AS pt_id, x1 AS x, z1 AS z FROM poly_edge WHERE ring=0 AND seq=0),
""" + inside_sql(points="firsts").strip() + """
SELECT a_id, b_id FROM cut UNION SELECT least(pt_id,poly_id), greatest(pt_id,poly_id) FROM inside WHERE pt_id<>poly_id""")
def _(t):
    # Containment may name the pair either way round; both orders are found, one is kept.
    return polygons.poly_intersects(t.poly_edge, t.poly_edge, "a_id < b_id")


@query("c6_within_distance", """
WITH v AS (SELECT poly_id, min(x1) AS x0, max(x1) AS xx, min(z1) AS z0, max(z1) AS zz FROM poly_edge WHERE ring=0 GROUP BY 1),
cand AS (SELECT a.poly_id AS a_id, b.poly_id AS b_id FROM v a JOIN v b ON a.poly_id<b.poly_id AND a.x0-12<=b.xx AND b.x0-12<=a.xx AND a.z0-12<=b.zz AND b.z0-12<=a.zz),
d AS (SELECT c.a_id, c.b_id, a.x1 AS px, a.z1 AS pz, b.x1, b.z1, b.x2, b.z2 FROM cand c JOIN poly_edge a ON a.poly_id=c.a_id JOIN poly_edge b ON b.poly_id=c.b_id
      UNION ALL SELECT c.a_id, c.b_id, b.x1, b.z1, a.x1, a.z1, a.x2, a.z2 FROM cand c JOIN poly_edge a ON a.poly_id=c.a_id JOIN poly_edge b ON b.poly_id=c.b_id),
dt AS (SELECT *, greatest(0e0,least(1e0,((px-x1)*(x2-x1)+(pz-z1)*(z2-z1))/((x2-x1)*(x2-x1)+(z2-z1)*(z2-z1)))) AS q FROM d),
near AS (SELECT DISTINCT a_id, b_id FROM dt WHERE pow(px-x1-q*(x2-x1),2)+pow(pz-z1-q*(z2-z1),2) <= 144),
ee AS (SELECT c.a_id, c.b_id,
  (a.x2-a.x1)*(b.z1-a.z1)-(a.z2-a.z1)*(b.x1-a.x1) AS o1, (a.x2-a.x1)*(b.z2-a.z1)-(a.z2-a.z1)*(b.x2-a.x1) AS o2,
  (b.x2-b.x1)*(a.z1-b.z1)-(b.z2-b.z1)*(a.x1-b.x1) AS o3, (b.x2-b.x1)*(a.z2-b.z1)-(b.z2-b.z1)*(a.x2-b.x1) AS o4
  FROM cand c JOIN poly_edge a ON a.poly_id=c.a_id JOIN poly_edge b ON b.poly_id=c.b_id),
firsts AS (SELECT poly_id AS pt_id, x1 AS x, z1 AS z FROM poly_edge WHERE ring=0 AND seq=0),
""" + inside_sql(points="firsts").strip() + """
SELECT a_id, b_id FROM near UNION SELECT a_id, b_id FROM ee WHERE sign(o1)*sign(o2)<0 AND sign(o3)*sign(o4)<0
UNION SELECT least(pt_id,poly_id), greatest(pt_id,poly_id) FROM inside WHERE pt_id<>poly_id""")
def _(t):
    return polygons.within_distance(t.poly_edge, t.poly_edge, 12.0, "a_id < b_id")


OWNER = """SELECT p.pt_id, CASE WHEN o.lo=o.hi THEN o.lo END AS entity_id,
 CASE WHEN o.lo IS NULL THEN 'unassigned' WHEN o.lo=o.hi THEN '{one}' ELSE '{many}' END AS method
FROM pts p LEFT JOIN (SELECT pt_id, min(entity_id) AS lo, max(entity_id) AS hi FROM held GROUP BY pt_id) o ON o.pt_id=p.pt_id"""


@query("d1_attribute_points", f"""WITH {inside_sql()},
held AS (SELECT i.pt_id, d.entity_id FROM inside i JOIN domains d ON d.poly_id=i.poly_id JOIN pts p ON p.pt_id=i.pt_id WHERE p.y >= d.min_y-5e-1)
""" + OWNER.format(one="source-footprint-and-height", many="ambiguous-source-footprints"))
def _(t):
    return attribution.attribute_points(t.pts, t.poly_edge, t.domains)


#: every fifth domain shares the envelope of its neighbour to the right, every seventh that of the one to the left; some count a little outside
ENVELOPES = """SELECT poly_id, entity_id, min_y, CASE WHEN poly_id%6=0 THEN 4e-1 WHEN poly_id%6=3 THEN 1e-1 END AS tolerance,
    CASE WHEN poly_id%5=0 THEN concat('building:', poly_id+1) WHEN poly_id%7=1 THEN concat('building:', poly_id-1) END AS shared_with FROM domains"""
#: a pair of entities that name each other keeps the name of the domain that comes first
SETTLED = """SELECT * EXCLUDE (shared_with), CASE WHEN EXISTS (SELECT 1 FROM {0} o WHERE o.entity_id=d.shared_with AND o.shared_with=d.entity_id AND o.poly_id<d.poly_id) THEN NULL ELSE shared_with END AS shared_with FROM {0} d"""
WITHIN = """(max(ring=0 AND (odd OR d2<=1e-8)) OR min(CASE WHEN ring=0 THEN d2 END)<=max(tolerance)*max(tolerance)) AND NOT max(ring>0 AND (odd OR d2<=1e-8))"""


@query("d1_shared_envelopes", f"""WITH {rings_sql(pad="4e-1")}, env AS ({ENVELOPES}), dm AS ({SETTLED.format("env")}),
cand AS (SELECT DISTINCT r.pt_id, d.entity_id, d.shared_with FROM (SELECT r.pt_id, r.poly_id FROM rings r JOIN dm ON dm.poly_id=r.poly_id GROUP BY r.pt_id, r.poly_id HAVING {WITHIN}) r
 JOIN dm d ON d.poly_id=r.poly_id JOIN pts p ON p.pt_id=r.pt_id WHERE p.y>=d.min_y-5e-1),
held AS (SELECT pt_id, entity_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.pt_id=c.pt_id AND o.shared_with=c.entity_id AND o.entity_id<>c.entity_id))
""" + OWNER.format(one="source-footprint-and-height", many="ambiguous-source-footprints"))
def _(t):
    return attribution.attribute_points(t.pts, t.poly_edge, t.sql(ENVELOPES))


@query("d2_attribute_ranges", f"""WITH {inside_sql()},
held AS (SELECT i.pt_id, d.entity_id FROM inside i JOIN domains d ON d.poly_id=i.poly_id JOIN pts p ON p.pt_id=i.pt_id
 WHERE p.y BETWEEN d.min_y-5e-1 AND d.max_y+5e-1 AND (p.pt_id%4<>0 OR p.pt_id%3 IN (d.poly_id%3, (d.poly_id+1)%3)))
""" + OWNER.format(one="source-range-footprint-and-height", many="ambiguous-source-ranges"))
def _(t):
    ranges = t.domains.withColumn("source_object_ids", F.array(F.col("poly_id") % 3, (F.col("poly_id") + 1) % 3))
    points = t.pts.withColumn("source_object_id", F.when(F.col("pt_id") % 4 == 0, F.col("pt_id") % 3))
    return attribution.attribute_ranges(points, t.poly_edge, ranges)


@query("d3_pip_tolerant", f"""WITH {rings_sql(pad="4e-1")}
SELECT pt_id, poly_id, max(ring=0 AND (odd OR d2<=1e-8)) AS inside FROM rings GROUP BY pt_id, poly_id
HAVING max(ring=0 AND (odd OR d2<=4e-1*4e-1)) AND NOT max(ring>0 AND (odd OR d2<=1e-8))""")
def _(t):
    return polygons.point_in_polygon_tolerant(t.pts, t.poly_edge, 0.4)


SEG_T = "greatest(0e0,least(1e0,((p.x-s.x1)*(s.x2-s.x1)+(p.z-s.z1)*(s.z2-s.z1))/((s.x2-s.x1)*(s.x2-s.x1)+(s.z2-s.z1)*(s.z2-s.z1))))"


@query("d4_nearest_line", f"""
WITH near AS (SELECT p.pt_id, s.entity_id, pow(p.x-s.x1-{SEG_T}*(s.x2-s.x1),2)+pow(p.z-s.z1-{SEG_T}*(s.z2-s.z1),2) AS d2
 FROM pts p JOIN road_seg s ON s.show_ground AND p.x BETWEEN least(s.x1,s.x2)-4 AND greatest(s.x1,s.x2)+4 AND p.z BETWEEN least(s.z1,s.z2)-4 AND greatest(s.z1,s.z2)+4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d2, entity_id) AS rn FROM near WHERE d2 < 16)
SELECT pt_id, entity_id, round(sqrt(d2),6) AS distance FROM ranked WHERE rn=1""")
def _(t):
    return attribution.nearest_line(t.pts, t.road_seg, 4.0).withColumn("distance", F.round("distance", 6))


@query("d5_nearest_polygon", f"""
WITH {inside_sql(edges="outline")}, rim AS (SELECT p.pt_id, s.poly_id, pow(p.x-s.x1-{SEG_T}*(s.x2-s.x1),2)+pow(p.z-s.z1-{SEG_T}*(s.z2-s.z1),2) AS d2
 FROM pts p JOIN poly_edge s ON s.ring=0 AND p.x BETWEEN least(s.x1,s.x2)-6 AND greatest(s.x1,s.x2)+6 AND p.z BETWEEN least(s.z1,s.z2)-6 AND greatest(s.z1,s.z2)+6),
al AS (SELECT * FROM rim WHERE d2<=36 UNION ALL SELECT pt_id, poly_id, 0e0 FROM inside),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d2, poly_id) AS rn FROM al)
SELECT pt_id, poly_id, round(sqrt(d2),6) AS distance FROM ranked WHERE rn=1""".replace(
    "WITH", "WITH outline AS (SELECT * FROM poly_edge WHERE ring=0),", 1))
def _(t):
    return attribution.nearest_polygon(t.pts, t.poly_edge, 6.0).withColumn("distance", F.round("distance", 6))


AREA = """area AS (SELECT poly_id, sum(CASE WHEN ring=0 THEN abs(a) ELSE -abs(a) END) AS net_area, sum(CASE WHEN ring=0 THEN abs(a) END) AS gross_area
 FROM (SELECT poly_id, ring, sum(x1*z2-x2*z1)/2 AS a FROM poly_edge GROUP BY poly_id, ring) r GROUP BY poly_id)"""


@query("d6_smallest_containing", f"""WITH {inside_sql()}, {AREA},
ranked AS (SELECT i.pt_id, i.poly_id, a.net_area, row_number() OVER (PARTITION BY i.pt_id ORDER BY a.net_area, i.poly_id) AS rn FROM inside i JOIN area a ON a.poly_id=i.poly_id)
SELECT pt_id, poly_id, net_area FROM ranked WHERE rn=1""")
def _(t):
    return attribution.smallest_containing(t.pts, t.poly_edge)


@query("d12_label_identity", f"""WITH labels2 AS (SELECT c_custkey AS pt_id, d.cx+(c_custkey%9-4)*6e0 AS x, d.cz+(c_custkey%5-2)*5e0 AS z, d.poly_id AS want FROM customer
 JOIN domains d ON d.poly_id=c_custkey%(SELECT count(*) FROM supplier)),
asg AS (SELECT pt_id, want AS poly_id FROM labels2 UNION ALL SELECT pt_id, want+1 FROM labels2 WHERE pt_id%10=0),
{inside_sql(points="labels2").strip()}
SELECT a.pt_id, count(*) AS assigned, count(i.poly_id) AS holding, bool_and(i.poly_id IS NOT NULL) AS matched
FROM asg a LEFT JOIN inside i ON i.pt_id=a.pt_id AND i.poly_id=a.poly_id GROUP BY a.pt_id""")
def _(t):
    labels = t.sql("""SELECT c_custkey AS pt_id, d.cx+(c_custkey%9-4)*6e0 AS x, d.cz+(c_custkey%5-2)*5e0 AS z, d.poly_id AS want
        FROM customer JOIN domains d ON d.poly_id=c_custkey%(SELECT count(*) FROM supplier)""")
    own = labels.select("pt_id", F.col("want").alias("poly_id"))
    assigned = own.unionByName(own.where("pt_id % 10 = 0").withColumn("poly_id", F.col("poly_id") + 1))
    return attribution.label_identity(labels, assigned, t.poly_edge)


@query("c3_segment_distance", f"""SELECT p.pt_id, s.seq, round(sqrt(pow(p.x-s.x1-{SEG_T}*(s.x2-s.x1),2)+pow(p.z-s.z1-{SEG_T}*(s.z2-s.z1),2)),6) AS distance
FROM pts p JOIN orders o ON o.o_orderkey=p.pt_id JOIN road_seg s ON s.line_id=o.o_custkey""")
def _(t):
    return (
        t.pts.join(t.orders.select(F.col("o_orderkey").alias("pt_id"), F.col("o_custkey").alias("line_id")), "pt_id")
        .join(t.road_seg, "line_id")
        .select("pt_id", "seq", F.round(seg_dist("x", "z", "x1", "z1", "x2", "z2"), 6).alias("distance"))
    )


@query("e5_poly_area", f"WITH {AREA} SELECT poly_id, net_area, gross_area FROM area")
def _(t):
    return polygons.poly_area(t.poly_edge)


CENTROID = """base AS (SELECT poly_id, min(x1) AS ox, min(z1) AS oz FROM poly_edge WHERE ring=0 GROUP BY poly_id),
mom AS (SELECT e.poly_id, e.ring, b.ox, b.oz, sum((x1-ox)*(z2-oz)-(x2-ox)*(z1-oz)) AS a2,
 sum((x1+x2-2*ox)*((x1-ox)*(z2-oz)-(x2-ox)*(z1-oz))) AS mx, sum((z1+z2-2*oz)*((x1-ox)*(z2-oz)-(x2-ox)*(z1-oz))) AS mz
 FROM poly_edge e JOIN base b ON b.poly_id=e.poly_id GROUP BY e.poly_id, e.ring, b.ox, b.oz),
cen AS (SELECT poly_id, max(ox)+sum(sign(a2)*CASE WHEN ring=0 THEN 1 ELSE -1 END*mx)/(3*sum(sign(a2)*CASE WHEN ring=0 THEN 1 ELSE -1 END*a2)) AS cx,
 max(oz)+sum(sign(a2)*CASE WHEN ring=0 THEN 1 ELSE -1 END*mz)/(3*sum(sign(a2)*CASE WHEN ring=0 THEN 1 ELSE -1 END*a2)) AS cz FROM mom GROUP BY poly_id)"""


@query("e6_poly_centroid", f"WITH {CENTROID} SELECT poly_id, round(cx,6) AS cx, round(cz,6) AS cz FROM cen")
def _(t):
    c = polygons.poly_centroid(t.poly_edge)
    return c.select("poly_id", F.round("cx", 6).alias("cx"), F.round("cz", 6).alias("cz"))


@query("e7_label_point", f"""WITH {CENTROID},
box0 AS (SELECT poly_id, min(x1) AS x0, max(x1) AS xx, min(z1) AS z0, max(z1) AS zz FROM poly_edge WHERE ring=0 GROUP BY 1),
ask AS (SELECT poly_id*1000 AS pt_id, round(cx,6) AS x, round(cz,6) AS z FROM cen UNION ALL
 SELECT poly_id*1000+1+i*17+j, x0+(xx-x0)*i/16e0, z0+(zz-z0)*j/16e0 FROM box0, range(0,17) a(i), range(0,17) b(j)),
{inside_sql("exclude", points="ask").strip()},
good AS (SELECT i.poly_id, a.x, a.z, i.pt_id%1000 AS k, pow(a.x-c.cx,2)+pow(a.z-c.cz,2) AS gap FROM inside i JOIN ask a ON a.pt_id=i.pt_id JOIN cen c ON c.poly_id=i.poly_id
 WHERE CAST(floor(i.pt_id/1000e0) AS BIGINT)=i.poly_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY poly_id ORDER BY CASE WHEN k=0 THEN 0 ELSE 1 END, round(gap,6), k) AS rn FROM good)
SELECT poly_id, round(x,6) AS x, round(z,6) AS z, CASE WHEN k=0 THEN 'centroid' ELSE 'grid' END AS method FROM ranked WHERE rn=1""")
def _(t):
    p = polygons.label_point(t.poly_edge)
    return p.select("poly_id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"), "method")


@query("c7_geometry_violations", """
WITH bad AS (SELECT poly_id, 0 AS part, ring, seq, CASE WHEN poly_id%9=0 AND seq=2 THEN CAST('NaN' AS DOUBLE) ELSE x1/3 END AS x1, z1*11e-1 AS z1,
 x2/3 AS x2, CASE WHEN poly_id%7=0 AND ring=0 THEN z1*11e-1 ELSE z2*11e-1 END AS z2 FROM poly_edge WHERE NOT (poly_id%11=0 AND seq>=2)),
ends AS (SELECT poly_id, ring, x1 AS x, z1 AS z, 1 AS way FROM bad UNION ALL SELECT poly_id, ring, x2, z2, -1 FROM bad), loose AS (SELECT DISTINCT poly_id, ring FROM (SELECT poly_id, ring, x, z FROM ends GROUP BY ALL HAVING sum(way)<>0)),
r AS (SELECT b.poly_id, b.part, b.ring, count(*) AS n, max(isnan(x1)) AS nf, max(l.poly_id IS NOT NULL) AS op, sum(x1*z2-x2*z1) AS a2, sum(abs(x1*z2)+abs(x2*z1)) AS big FROM bad b LEFT JOIN loose l ON l.poly_id=b.poly_id AND l.ring=b.ring GROUP BY 1,2,3)
SELECT poly_id, part, ring, 'not-finite' AS rule FROM r WHERE nf
UNION ALL SELECT poly_id, part, ring, 'too-few-vertices' FROM r WHERE n<3
UNION ALL SELECT poly_id, part, ring, 'open-ring' FROM r WHERE NOT nf AND op
UNION ALL SELECT poly_id, part, ring, 'zero-area' FROM r WHERE NOT nf AND abs(a2)<=1e-12*big""")
def _(t):
    broken = (
        t.poly_edge.where("NOT (poly_id % 11 = 0 AND seq >= 2)")
        .withColumns({"x1": F.col("x1") / 3, "x2": F.col("x2") / 3, "z1": F.col("z1") * 1.1, "z2": F.col("z2") * 1.1})
        .withColumn("z2", F.when((F.col("poly_id") % 7 == 0) & (F.col("ring") == 0), F.col("z1")).otherwise(F.col("z2")))
        .withColumn("x1", F.when((F.col("poly_id") % 9 == 0) & (F.col("seq") == 2), F.lit(float("nan"))).otherwise(F.col("x1")))
    )
    return polygons.geometry_violations(broken)


#: bounds with faults: swapped sides, missing and infinite ones, and floors of which a vertex lies higher
BOUNDS = """SELECT poly_id AS id, cx-r AS min_x, CASE WHEN poly_id%11=3 THEN max_y+1 ELSE min_y END AS min_y, CASE WHEN poly_id%13=4 THEN CAST('NaN' AS DOUBLE) WHEN poly_id%17=5 THEN NULL ELSE cz-r END AS min_z,
    CASE WHEN poly_id%19=6 THEN CAST('Infinity' AS DOUBLE) WHEN poly_id%7=1 THEN cx-r-1 ELSE cx+r END AS max_x, max_y, cz+r AS max_z,
    CASE WHEN poly_id%2=0 THEN min_y END AS low_y, CASE WHEN poly_id%2=0 THEN min_y+CASE WHEN poly_id%6=2 THEN 5e-1 ELSE 0e0 END END AS high_y FROM domains"""


@query("c7_box_violations", f"""WITH b AS ({BOUNDS}), w AS (SELECT *, coalesce(NOT isfinite(min_x) OR NOT isfinite(max_x) OR NOT isfinite(min_y) OR NOT isfinite(max_y) OR NOT isfinite(min_z) OR NOT isfinite(max_z), TRUE) AS wild FROM b)
SELECT id, 'bounds-not-finite' AS rule FROM w WHERE wild UNION ALL SELECT id, 'bounds-reversed' FROM w WHERE NOT wild AND (min_x>max_x OR min_y>max_y OR min_z>max_z) UNION ALL SELECT id, 'not-planar' FROM w WHERE high_y>low_y""")
def _(t):
    return polygons.box_violations(t.sql(BOUNDS))
