"""Triangle soups: components, edges, rays and corrections."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.catalogue.scalars import NORMAL
from landfold.operators import mesh as m

# Components in the fixture are strips of six faces or what is left of them when some are lifted; closure by recursion.
VERT = """vert AS (SELECT tile_id, tri_idx, {q}(x1) AS qx, {q}(y1) AS qy, {q}(z1) AS qz FROM tri UNION ALL SELECT tile_id, tri_idx, {q}(x2), {q}(y2), {q}(z2) FROM tri UNION ALL SELECT tile_id, tri_idx, {q}(x3), {q}(y3), {q}(z3) FROM tri)""".replace("{q}", "")


def comp_sql(scope="", name="comp"):
    also = " AND a.tile_id=b.tile_id" if scope else ""
    return f"""{VERT}, adj AS (SELECT DISTINCT a.tri_idx AS u, b.tri_idx AS v FROM vert a JOIN vert b ON a.qx=b.qx AND a.qy=b.qy AND a.qz=b.qz{also}),
 cl AS (SELECT u, v FROM adj UNION SELECT c.u, a.v FROM cl c JOIN adj a ON a.u=c.v), {name} AS (SELECT u AS tri_idx, min(v) AS component FROM cl GROUP BY u)"""


@query("g3_components", f"WITH {comp_sql()} SELECT tri_idx, component FROM comp")
def _(t):
    return m.components(t.tri)


@query("g4_components_in_tile", f"WITH {comp_sql('tile')} SELECT tri_idx, component FROM comp")
def _(t):
    return m.components(t.tri, scope=["tile_id"])


@query("g5_seed_closure", f"""WITH {comp_sql('tile')}, hit AS (SELECT DISTINCT component FROM comp WHERE tri_idx%50=3), vc AS (SELECT v.*, c.component FROM vert v JOIN comp c ON c.tri_idx=v.tri_idx)
SELECT h.component, (SELECT count(*) FROM comp c WHERE c.component=h.component) AS faces, EXISTS (SELECT 1 FROM vc a JOIN vc b ON a.qx=b.qx AND a.qy=b.qy AND a.qz=b.qz WHERE a.component=h.component AND b.component NOT IN (SELECT component FROM hit)) AS touches_retained FROM hit h""")
def _(t):
    comp = m.components(t.tri, scope=["tile_id"])
    return m.closure(t.tri, comp, t.tri.where("tri_idx%50=3"))


STATS = f"""{NORMAL}, tf AS (SELECT n.*, c.component, sqrt(nx*nx+ny*ny+nz*nz)/2 AS area, (y1+y2+y3)/3-(n.tri_idx%30) AS gap FROM n JOIN comp c ON c.tri_idx=n.tri_idx),
stats AS (SELECT component, count(*) AS faces, sum(area) AS area, min(least(x1,x2,x3)) AS min_x, min(least(y1,y2,y3)) AS min_y, min(least(z1,z2,z3)) AS min_z, max(greatest(x1,x2,x3)) AS max_x, max(greatest(y1,y2,y3)) AS max_y, max(greatest(z1,z2,z3)) AS max_z, quantile_cont(gap,5e-2) AS gap_p05, quantile_cont(gap,5e-1) AS gap_median FROM tf GROUP BY component)"""


def ground(t):
    return t.tri.select("tri_idx", (F.col("tri_idx") % 30).cast("double").alias("ground"))


def tidy(s):
    return s.withColumns({c: F.round(c, 6) for c in ("area", "gap_p05", "gap_median")})


TIDY = "component, faces, round(area,6) AS area, min_x, min_y, min_z, max_x, max_y, max_z, round(gap_p05,6) AS gap_p05, round(gap_median,6) AS gap_median"
GATE = "faces<=120 AND area BETWEEN 1e-2 AND 50 AND greatest(max_x-min_x,max_z-min_z)<=8 AND max_y-min_y<=8 AND gap_p05>2"


@query("e8_component_stats", f"WITH {comp_sql()}, {STATS} SELECT {TIDY} FROM stats")
def _(t):
    return tidy(m.component_stats(t.tri, m.components(t.tri), ground(t)))


@query("c13_floater_gate", f"WITH {comp_sql()}, {STATS} SELECT {TIDY} FROM stats WHERE {GATE}")
def _(t):
    return tidy(m.floater_gate(m.component_stats(t.tri, m.components(t.tri), ground(t))))


@query("d23_isolated", f"""WITH {comp_sql('tile')}, vc AS (SELECT v.*, c.component FROM vert v JOIN comp c ON c.tri_idx=v.tri_idx)
SELECT DISTINCT a.component, a.tile_id FROM vc a WHERE a.component NOT IN (SELECT x.component FROM vc x JOIN vc y ON x.qx=y.qx AND x.qy=y.qy AND x.qz=y.qz AND x.tile_id<>y.tile_id)""")
def _(t):
    comp = m.components(t.tri, scope=["tile_id"])
    cand = comp.join(t.tri.select("tri_idx", "tile_id"), "tri_idx").select("component", "tile_id").distinct()
    return m.isolated(cand, comp, t.tri)


EDGE3 = """ed AS (SELECT tri_idx, x1 AS px,y1 AS py,z1 AS pz,x2 AS qx,y2 AS qy,z2 AS qz FROM tri UNION ALL SELECT tri_idx, x2,y2,z2,x3,y3,z3 FROM tri UNION ALL SELECT tri_idx, x3,y3,z3,x1,y1,z1 FROM tri),
un AS (SELECT tri_idx, CASE WHEN (px,py,pz)<=(qx,qy,qz) THEN px ELSE qx END AS ax, CASE WHEN (px,py,pz)<=(qx,qy,qz) THEN py ELSE qy END AS ay, CASE WHEN (px,py,pz)<=(qx,qy,qz) THEN pz ELSE qz END AS az,
 CASE WHEN (px,py,pz)<=(qx,qy,qz) THEN qx ELSE px END AS bx, CASE WHEN (px,py,pz)<=(qx,qy,qz) THEN qy ELSE py END AS "by", CASE WHEN (px,py,pz)<=(qx,qy,qz) THEN qz ELSE pz END AS bz FROM ed)"""


@query("e22_boundary_edges", f"""WITH {EDGE3} SELECT ax,ay,az,bx,"by",bz FROM un GROUP BY 1,2,3,4,5,6 HAVING count(*)=1""")
def _(t):
    return m.boundary_edges(t.tri)


@query("e37_crease_edges", f"""WITH {NORMAL}, {EDGE3}, j AS (SELECT u.*, nx/sqrt(nx*nx+ny*ny+nz*nz) AS ux, ny/sqrt(nx*nx+ny*ny+nz*nz) AS uy, nz/sqrt(nx*nx+ny*ny+nz*nz) AS uz FROM un u JOIN n ON n.tri_idx=u.tri_idx)
SELECT ax,ay,az,bx,"by",bz, count(*) AS faces FROM j GROUP BY 1,2,3,4,5,6 HAVING count(*)=1 OR (count(*)=2 AND (sum(ux)*sum(ux)+sum(uy)*sum(uy)+sum(uz)*sum(uz))/2-1 < cos(radians(35e0))-1e-12)""")
def _(t):
    return m.crease_edges(t.tri)


@query("e23_dedup_segments", """SELECT DISTINCT CASE WHEN (x1,z1)<=(x2,z2) THEN x1 ELSE x2 END AS x1, CASE WHEN (x1,z1)<=(x2,z2) THEN z1 ELSE z2 END AS z1, CASE WHEN (x1,z1)<=(x2,z2) THEN x2 ELSE x1 END AS x2, CASE WHEN (x1,z1)<=(x2,z2) THEN z2 ELSE z1 END AS z2 FROM road_seg""")
def _(t):
    seg = t.road_seg.select("x1", "z1", "x2", "z2")
    turned = seg.select(F.col("x2").alias("x1"), F.col("z2").alias("z1"), F.col("x1").alias("x2"), F.col("z1").alias("z2"))
    flat = seg.withColumns({"x2": F.col("x1"), "z2": F.col("z1")})
    return m.dedup_segments(seg.unionByName(turned).unionByName(flat))


@query("e28_witnesses", f"""WITH {NORMAL}, a AS (SELECT tile_id, tri_idx%2 AS layer, tri_idx, round(sqrt(nx*nx+ny*ny+nz*nz)/2,6) AS area, CASE WHEN abs(ny/sqrt(nx*nx+ny*ny+nz*nz))>=85e-2 THEN 'roof' WHEN abs(ny/sqrt(nx*nx+ny*ny+nz*nz))>=6e-1 THEN 'ground' WHEN abs(ny/sqrt(nx*nx+ny*ny+nz*nz))<=25e-2 THEN 'wall' ELSE 'slanted' END AS slope FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY tile_id, layer, slope ORDER BY area DESC, tri_idx) AS rn FROM a) SELECT tile_id, layer, slope, tri_idx, area FROM k WHERE rn=1""")
def _(t):
    from landfold.functions.geometry import face_normal, normalise, slope_class

    tri = t.tri.withColumns({"layer": F.col("tri_idx") % 2, "slope": slope_class(normalise(face_normal())[1])})
    return m.witnesses(tri, ["tile_id", "layer", "slope"]).withColumn("area", F.round("area", 6))


@query("d27_apply_corrections", """SELECT tile_id, count(CASE WHEN tri_idx%13=4 THEN 1 END) AS asked, count(CASE WHEN tri_idx%13=4 THEN 1 END) AS gone, CAST(0 AS BIGINT) AS altered FROM tri GROUP BY 1""")
def _(t):
    removed = t.tri.where("tri_idx%13=4").select("tile_id", "tri_idx")
    return m.correction_proof(t.tri, removed, m.apply_corrections(t.tri, removed))


@query("d27_corrected_faces", "SELECT tile_id, tri_idx, x1, y1, z1, x2, y2, z2, x3, y3, z3 FROM tri WHERE tri_idx%13<>4 OR tile_id%5=2")
def _(t):
    # a removal names a face of a tile: with another tile's number it removes nothing
    removed = t.tri.where("tri_idx%13=4").selectExpr("CASE WHEN tile_id%5=2 THEN tile_id+1000000 ELSE tile_id END AS tile_id", "tri_idx")
    return m.apply_corrections(t.tri, removed).select("tile_id", "tri_idx", *[f"{a}{i}" for i in (1, 2, 3) for a in "xyz"])


RAYS = """rays AS (SELECT tri_idx AS ray_id, (x1+x2+x3)/3+6 AS ox, (y1+y2+y3)/3+24 AS oy, (z1+z2+z3)/3+8 AS oz, -6e0/26 AS dx, -24e0/26 AS dy, -8e0/26 AS dz FROM tri),
rt AS (SELECT r.*, t.tile_id, t.tri_idx, x1,y1,z1, x2-x1 AS e1x, y2-y1 AS e1y, z2-z1 AS e1z, x3-x1 AS e2x, y3-y1 AS e2y, z3-z1 AS e2z FROM rays r JOIN tri t ON least(x1,x2,x3)<=ox AND greatest(x1,x2,x3)>=ox-30 AND least(z1,z2,z3)<=oz AND greatest(z1,z2,z3)>=oz-30),
dt AS (SELECT *, dy*e2z-dz*e2y AS px, dz*e2x-dx*e2z AS py, dx*e2y-dy*e2x AS pz, ox-x1 AS sx, oy-y1 AS sy, oz-z1 AS sz FROM rt),
dd AS (SELECT *, e1x*px+e1y*py+e1z*pz AS det, sy*e1z-sz*e1y AS qx, sz*e1x-sx*e1z AS qy, sx*e1y-sy*e1x AS qz FROM dt),
hit AS (SELECT ray_id, tile_id, tri_idx, (e2x*qx+e2y*qy+e2z*qz)/det AS dist FROM dd WHERE abs(det)>1e-10 AND (sx*px+sy*py+sz*pz)/det>=0 AND (dx*qx+dy*qy+dz*qz)/det>=0 AND (sx*px+sy*py+sz*pz)/det+(dx*qx+dy*qy+dz*qz)/det<=1 AND (e2x*qx+e2y*qy+e2z*qz)/det>0 AND (e2x*qx+e2y*qy+e2z*qz)/det<=80)"""


def hits(t):
    mid = {a: (F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 3 for a in "xyz"}
    rays = t.tri.select(F.col("tri_idx").alias("ray_id"), *[(mid[a] + b).alias(f"o{a}") for a, b in zip("xyz", (6, 24, 8))],
                                             *[F.lit(-b / 26).alias(f"d{a}") for a, b in zip("xyz", (6, 24, 8))])
    return m.ray_hits(rays, t.tri, 80.0)


@query("d8_ray_hits", f"WITH {RAYS} SELECT ray_id, tile_id, tri_idx, round(dist,6) AS dist FROM hit")
def _(t):
    return hits(t).withColumn("dist", F.round("dist", 6))


@query("f2_first_hits", f"WITH {RAYS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ray_id ORDER BY dist, tri_idx) AS INTEGER) AS rank FROM hit) SELECT ray_id, tile_id, tri_idx, round(dist,6) AS dist, rank FROM k WHERE rank<=2")
def _(t):
    return m.first_hit(hits(t), 2).withColumn("dist", F.round("dist", 6))


@query("f3_before_blocker", f"WITH {RAYS}, b AS (SELECT ray_id, min(dist) AS block FROM hit WHERE tri_idx%4=1 GROUP BY 1) SELECT h.ray_id, h.tri_idx, round(dist,6) AS dist FROM hit h LEFT JOIN b ON b.ray_id=h.ray_id WHERE tri_idx%4<>1 AND (block IS NULL OR dist<block)")
def _(t):
    h = hits(t)
    return m.before_blocker(h.where("tri_idx%4<>1"), h.where("tri_idx%4=1")).select("ray_id", "tri_idx", F.round("dist", 6).alias("dist"))


@query("f4_specific_hit", f"""WITH {RAYS}, e AS (SELECT ray_id, dist, 'e'||tri_idx AS entity_id, CASE tri_idx%3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS rk FROM hit), f AS (SELECT *, min(dist) OVER (PARTITION BY ray_id) AS first FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY rk, dist, entity_id) AS rn FROM f WHERE dist<=first+8) SELECT ray_id, entity_id, round(dist,6) AS dist FROM k WHERE rn=1""")
def _(t):
    kind = F.get(F.array(F.lit("building"), F.lit("floor"), F.lit("space")), (F.col("tri_idx") % 3).cast("int"))
    h = hits(t).select("ray_id", "dist", F.concat(F.lit("e"), "tri_idx").alias("entity_id"), kind.alias("type"))
    return m.specific_hit(h, near=8.0).withColumn("dist", F.round("dist", 6))


@query("e29_hit_histogram", f"WITH {RAYS}, {comp_sql()} SELECT c.component, count(*) AS hits, count(DISTINCT h.tri_idx) AS faces FROM hit h JOIN comp c ON c.tri_idx=h.tri_idx GROUP BY 1")
def _(t):
    return m.hit_histogram(hits(t), m.components(t.tri))
