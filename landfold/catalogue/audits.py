"""Composite reports, each one query."""

from pyspark.sql import functions as F

from landfold.catalogue import mesh as meshq, query
from landfold.catalogue.hierarchy import REL, relations
from landfold.catalogue.linkage import CLASSES
from landfold.catalogue.raster import CELLS, DOWN, GRID, STEP, dem_rows, dem_sql
from landfold.catalogue.scalars import NAMES, TRIAGE, triage_input
from landfold.catalogue.spatial import CENTROID, SEG_T, SETTLED, WITHIN, rings_sql, FOLDS
from landfold.catalogue.summaries import FIT, controls, rounded
from landfold.functions import geometry as g, text
from landfold.operators import audits, hierarchy as h, linkage as l, mesh as m, polygons, raster as r, reports, scoring, summaries as s


#: one table of domains of all kinds
KIND = "CASE WHEN poly_id%16=2 THEN 'association' WHEN poly_id%4=1 THEN 'surface' WHEN poly_id%2=0 THEN 'footprint' ELSE 'range' END"
OF_KIND = f"""SELECT poly_id, {KIND} AS kind, concat(CASE {KIND} WHEN 'association' THEN 'assoc:' WHEN 'surface' THEN 'outdoor:' ELSE 'building:' END, poly_id) AS entity_id, min_y, max_y,
    CASE WHEN poly_id%6=0 THEN 4e-1 END AS tolerance, CASE WHEN poly_id%4=0 THEN concat('building:', poly_id+(SELECT m+m%2 FROM world)) END AS shared_with FROM domains"""


def cascade_sql(points: str) -> str:
    """Owner and method of the rows of points (pt_id, x, y, z, ny, ex, role, obj, ground, kept), kind by kind."""
    return f"""{rings_sql(pad="4e-1", points=points)}, kd AS ({OF_KIND}), dm AS ({SETTLED.format("kd")}),
area AS (SELECT poly_id, sum(CASE WHEN ring=0 THEN abs(a) ELSE -abs(a) END) AS net FROM (SELECT poly_id, ring, sum(x1*z2-x2*z1)/2 AS a FROM poly_edge GROUP BY 1,2) q GROUP BY 1),
f AS (SELECT *, coalesce(ny>=6e-1,FALSE) AND (coalesce(abs(y-ground)<=125e-2,FALSE) OR kept) AS lk, coalesce(ny>=6e-1,FALSE) AND (coalesce(abs(y-ground)<=2,FALSE) OR kept) AS nr FROM {points}),
held AS (SELECT r.pt_id, r.poly_id FROM rings r JOIN dm ON dm.poly_id=r.poly_id GROUP BY r.pt_id, r.poly_id HAVING {WITHIN}),
c AS (SELECT f.pt_id, d.*, net FROM held h JOIN dm d ON d.poly_id=h.poly_id JOIN area a ON a.poly_id=h.poly_id JOIN f ON f.pt_id=h.pt_id WHERE ex IS NULL AND
  CASE kind WHEN 'association' THEN role='baseline' AND y BETWEEN min_y AND max_y WHEN 'surface' THEN nr WHEN 'footprint' THEN NOT lk AND y>=min_y-5e-1
   ELSE NOT lk AND y BETWEEN min_y-5e-1 AND max_y+5e-1 AND CASE WHEN obj IS NULL THEN role IN ('baseline','photogrammetry') ELSE obj IN (d.poly_id%3, (d.poly_id+1)%3) END END),
asn AS (SELECT pt_id, arg_min(entity_id, poly_id) AS who FROM c WHERE kind='association' GROUP BY 1),
sf AS (SELECT pt_id, arg_min(entity_id, (net, poly_id)) AS who FROM c WHERE kind='surface' GROUP BY 1),
ft AS (SELECT pt_id, min(entity_id) AS lo, max(entity_id) AS hi FROM c WHERE kind='footprint' AND NOT EXISTS (SELECT 1 FROM c o WHERE o.kind='footprint' AND o.pt_id=c.pt_id AND o.shared_with=c.entity_id AND o.entity_id<>c.entity_id) GROUP BY 1),
rg AS (SELECT pt_id, min(entity_id) AS lo, max(entity_id) AS hi FROM c WHERE kind='range' GROUP BY 1),
nl AS (SELECT p.pt_id, s.entity_id, pow(p.x-s.x1-{SEG_T}*(s.x2-s.x1),2)+pow(p.z-s.z1-{SEG_T}*(s.z2-s.z1),2) AS d2 FROM f p JOIN road_seg s ON p.nr AND p.ex IS NULL AND s.show_ground AND p.x BETWEEN least(s.x1,s.x2)-4 AND greatest(s.x1,s.x2)+4 AND p.z BETWEEN least(s.z1,s.z2)-4 AND greatest(s.z1,s.z2)+4),
rd AS (SELECT pt_id, arg_min(entity_id, (d2, entity_id)) AS who FROM nl WHERE d2<16 GROUP BY 1),
told AS (SELECT f.pt_id, CASE WHEN ex IS NOT NULL THEN ex WHEN asn.who IS NOT NULL THEN asn.who WHEN sf.who IS NOT NULL THEN sf.who WHEN ft.lo IS NOT NULL THEN CASE WHEN ft.lo=ft.hi THEN ft.lo END WHEN rg.lo IS NOT NULL THEN CASE WHEN rg.lo=rg.hi THEN rg.lo END ELSE rd.who END AS entity_id,
 CASE WHEN ex IS NOT NULL THEN 'explicit-source-owner' WHEN asn.who IS NOT NULL THEN 'local-source-representation-association' WHEN sf.who IS NOT NULL THEN 'source-outdoor-domain-near-ground'
  WHEN ft.lo IS NOT NULL THEN CASE WHEN ft.lo=ft.hi THEN 'source-footprint-and-height' ELSE 'ambiguous-source-footprints' END
  WHEN rg.lo IS NOT NULL THEN CASE WHEN rg.lo=rg.hi THEN 'source-range-footprint-and-height' ELSE 'ambiguous-source-ranges' END WHEN rd.who IS NOT NULL THEN 'source-road-near-ground' WHEN lk THEN 'unassigned-ground' ELSE 'unassigned-visible-surface' END AS method
 FROM f LEFT JOIN asn ON asn.pt_id=f.pt_id LEFT JOIN sf ON sf.pt_id=f.pt_id LEFT JOIN ft ON ft.pt_id=f.pt_id LEFT JOIN rg ON rg.pt_id=f.pt_id LEFT JOIN rd ON rd.pt_id=f.pt_id)"""


def of_kind(t):
    d = t.sql(OF_KIND)
    return d.withColumns({"roles": F.array(F.lit("baseline")), "source_object_ids": F.array(F.col("poly_id") % 3, (F.col("poly_id") + 1) % 3)})


@query("k1_attribution_cascade", f"""WITH {dem_sql("triangle")}, pk AS (SELECT q.*, d.h AS ground, (q.pt_id%10)/9e0 AS ny, CASE WHEN q.pt_id%50=0 THEN 'building:'||(q.pt_id%97) END AS ex, ['baseline','photogrammetry','exterior'][q.pt_id%3+1] AS role,
 CASE WHEN q.pt_id%5=0 THEN q.pt_id%3 END AS obj, q.pt_id%71=0 AS kept FROM pts q LEFT JOIN dem d ON d.pt_id=q.pt_id), {cascade_sql("pk")} SELECT pt_id, entity_id, method FROM told""")
def _(t):
    n = dem_rows(t)
    k = F.col("pt_id")
    role = F.get(F.array(F.lit("baseline"), F.lit("photogrammetry"), F.lit("exterior")), (k % 3).cast("int"))
    p = t.pts.withColumns({"ny": (k % 10) / 9, "explicit_id": F.when(k % 50 == 0, F.concat(F.lit("building:"), k % 97)), "role": role,
                           "source_object_id": F.when(k % 5 == 0, k % 3), "preserved": k % 71 == 0})
    ground = r.sample_dem(t.pts, t.dem_cell, STEP, n, n, "triangle", name="ground")
    return audits.attribute_cascade(p, ground, t.poly_edge, of_kind(t), t.road_seg, 0.4)


#: hits along rays of four points each; near ones lie a hundredth apart
HITS = """SELECT pt_id, CAST(floor(pt_id/4e0) AS BIGINT) AS ray_id, ((pt_id*7)%12)/1e2 AS dist, x, y, z, (pt_id%10)/1e1 AS ny, CASE WHEN pt_id%4=0 THEN 'photogrammetry' WHEN pt_id%4=1 THEN 'exterior' ELSE 'baseline' END AS role,
    CASE WHEN pt_id%9=0 THEN pt_id%(SELECT count(*) FROM part) END AS source_object_id, CASE WHEN pt_id%13=0 THEN concat('floor:', pt_id%97) WHEN pt_id%13=5 THEN concat('space:', pt_id) WHEN pt_id%13=7 THEN 'nobody' END AS bound_id FROM pts"""
OBJECT = "CASE WHEN p_partkey%7=0 THEN NULL WHEN p_partkey%3=0 THEN 'building:'||p_partkey%50 ELSE 'bundle:'||p_partkey%20 END"


@query("k1_pick_entities", f"""WITH {dem_sql("triangle")}, hits AS ({HITS}), smp AS (SELECT h.*, m.mask_id, m.r, m.g, m.b, m.a FROM hits h JOIN mask_cell m ON m.row_no=floor(h.z/8) AND m.col_no=floor(h.x/8)),
 spared AS (SELECT DISTINCT pt_id FROM smp WHERE mask_id=4 AND r>127 AND abs(y-g-b/256e0)<=125e-2 AND ny>=6e-1),
 dis AS (SELECT pt_id FROM smp WHERE r>127 AND ((role='photogrammetry' AND mask_id=0 AND y BETWEEN 0 AND 40 AND pt_id NOT IN (SELECT pt_id FROM spared)) OR (role='exterior' AND mask_id=2 AND y BETWEEN 5 AND 30))),
 obj AS (SELECT p_partkey AS source_object_id, {OBJECT} AS owner FROM part),
 seen AS (SELECT h.*, CASE WHEN e.entity_id IS NOT NULL THEN e.entity_id END AS who, e.type FROM hits h LEFT JOIN obj o ON o.source_object_id=h.source_object_id LEFT JOIN entities e ON e.entity_id=coalesce(h.bound_id, o.owner) WHERE h.pt_id NOT IN (SELECT pt_id FROM dis)),
 front AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY dist, pt_id) AS place, min(dist) OVER (PARTITION BY ray_id) AS first FROM seen),
 bd AS (SELECT ray_id, pt_id, who, row_number() OVER (PARTITION BY ray_id ORDER BY CASE WHEN type IN ('space','facility','connector') THEN 0 WHEN type='floor' THEN 1 ELSE 2 END, dist, pt_id) AS rk FROM front WHERE who IS NOT NULL AND dist<=first+2e-2),
 pk AS (SELECT f.pt_id, f.ray_id, x, y, z, ny, role, source_object_id AS obj, b.who AS ex, coalesce(b.pt_id, f.pt_id) AS hit_id, d.h AS ground, f.pt_id IN (SELECT pt_id FROM spared) AS kept
  FROM front f LEFT JOIN bd b ON b.ray_id=f.ray_id AND b.rk=1 LEFT JOIN dem d ON d.pt_id=f.pt_id WHERE place=1), {cascade_sql("pk")}
SELECT ray_id, hit_id, t.entity_id, t.method FROM told t JOIN pk ON pk.pt_id=t.pt_id""")
def _(t):
    n = dem_rows(t)
    k = F.col("p_partkey")
    objects = t.part.select(k.alias("source_object_id"), F.concat(F.lit("bundle:"), k % 20).alias("bundle_id"), F.when(k % 7 == 0, "source-photogrammetry-gap-surface").otherwise("plain").alias("role"), F.lit("plain").alias("ownership"))
    over = t.part.where("p_partkey%3=0").select(k.alias("source_object_id"), F.concat(F.lit("building:"), k % 50).alias("entity_id"), F.lit(0).alias("ord"))
    rules = t.spark.createDataFrame([("photogrammetry", 0, 0.0, 40.0, True, False, 0.0), ("exterior", 2, 5.0, 30.0, False, False, 0.0)],
                                    "role string, mask_id long, min_y double, max_y double, replacement boolean, encoded boolean, clearance double")
    ground = r.sample_dem(t.pts, t.dem_cell, STEP, n, n, "triangle", name="ground")
    return audits.pick_entities(t.sql(HITS), t.mask_cell, rules, 8.0, 4, objects, over, t.entities, ground, t.poly_edge, of_kind(t), t.road_seg, 0.4)


@query("k2_entity_search", f"""SELECT 'building:'||ent_no AS entity_id, list_contains(ns,'体育馆5') AS exact FROM (SELECT ent_no, list_transform(list_filter([name,alias,en,hant,hans], lambda v: v IS NOT NULL), lambda v: trim(regexp_replace(lower(translate(v,'{text.TRADITIONAL}寳','{text.SIMPLIFIED}宝')),'\\s+',' ','g'))) AS ns FROM ({NAMES}) q) z WHERE contains(array_to_string(ns,' '),'体育馆5')""")
def _(t):
    e = t.named.select("entity_id", F.col("ent_no").alias("ord"), "name", F.array_compact(F.array("alias")).alias("aliases"))
    return audits.search_entities(e, "體育館5")


@query("k5_floater_audit", f"""WITH {meshq.comp_sql('tile')}, {meshq.STATS}, vc AS (SELECT v.*, c.component FROM vert v JOIN comp c ON c.tri_idx=v.tri_idx), sh AS (SELECT DISTINCT x.component FROM vc x JOIN vert y ON x.qx=y.qx AND x.qy=y.qy AND x.qz=y.qz AND x.tile_id<>y.tile_id),
pr AS (SELECT cx-r AS x0, cx+r AS x9, cz-r AS z0, cz+r AS z9, min_y AS y0, max_y AS y9 FROM domains WHERE poly_id%2=0)
SELECT {meshq.TIDY} FROM stats s WHERE {meshq.GATE} AND component NOT IN (SELECT component FROM sh) AND NOT EXISTS (SELECT 1 FROM pr WHERE s.min_x<=x9 AND x0<=s.max_x AND s.min_z<=z9 AND z0<=s.max_z AND s.min_y<=y9 AND y0<=s.max_y) ORDER BY round(s.area,6), round(s.gap_p05,6), component LIMIT 20""")
def _(t):
    box = {f"{n}_{a}": F.col(f"c{a}") + sgn * F.col("r") for a in "xz" for n, sgn in (("min", -1), ("max", 1))}
    prot = t.domains.where("poly_id%2=0").withColumns(box)
    # Rounded before ranking so that equal areas tie on both engines.
    tri = t.tri
    a = audits.floater_audit(tri, meshq.ground(t), prot, top=20)
    return meshq.tidy(a).drop("tile_id")


#: views over the faces, looking down at different slants
EYES = "SELECT p_partkey AS pose_id, x1+3 AS ex, y1+40 AS ey, z1-6 AS ez, CAST(p_partkey%3-1 AS DOUBLE)*2e-1 AS fx, -1e0 AS fy, 3e-1 AS fz FROM part JOIN tri ON tri_idx=p_partkey"


@query("k7_view_histogram", f"""WITH RECURSIVE {meshq.comp_sql()}, ps AS (SELECT *, sqrt(fx*fx+fy*fy+fz*fz) AS ln FROM ({EYES}) q), f AS (SELECT pose_id, ex, ey, ez, fx/ln AS fx, fy/ln AS fy, fz/ln AS fz FROM ps), r0 AS (SELECT *, -fz/sqrt(fz*fz+fx*fx) AS rx, 0e0 AS ry, fx/sqrt(fz*fz+fx*fx) AS rz FROM f), u0 AS (SELECT *, ry*fz-rz*fy AS ux, rz*fx-rx*fz AS uy, rx*fy-ry*fx AS uz FROM r0),
px AS (SELECT *, ((c+5e-1)/8*2-1)*tan(radians(2e1))*8/6 AS a, (1-(w+5e-1)/6*2)*tan(radians(2e1)) AS b FROM u0, range(2,6) q(c), range(1,5) s(w)), d0 AS (SELECT *, fx+a*rx+b*ux AS vx, fy+a*ry+b*uy AS vy, fz+a*rz+b*uz AS vz FROM px),
rays AS (SELECT struct_pack(p := pose_id, w := w, c := c) AS ray_id, ex AS ox, ey AS oy, ez AS oz, vx/sqrt(vx*vx+vy*vy+vz*vz) AS dx, vy/sqrt(vx*vx+vy*vy+vz*vz) AS dy, vz/sqrt(vx*vx+vy*vy+vz*vz) AS dz FROM d0),
rt AS (SELECT r.*, t.tri_idx, x1,y1,z1, x2-x1 AS e1x, y2-y1 AS e1y, z2-z1 AS e1z, x3-x1 AS e2x, y3-y1 AS e2y, z3-z1 AS e2z FROM rays r JOIN tri t ON least(x1,x2,x3)<=ox+60 AND greatest(x1,x2,x3)>=ox-60 AND least(z1,z2,z3)<=oz+60 AND greatest(z1,z2,z3)>=oz-60),
dt AS (SELECT *, dy*e2z-dz*e2y AS qpx, dz*e2x-dx*e2z AS qpy, dx*e2y-dy*e2x AS qpz, ox-x1 AS sx, oy-y1 AS sy, oz-z1 AS sz FROM rt), dd AS (SELECT *, e1x*qpx+e1y*qpy+e1z*qpz AS det, sy*e1z-sz*e1y AS qx, sz*e1x-sx*e1z AS qy, sx*e1y-sy*e1x AS qz FROM dt),
hit AS (SELECT ray_id, tri_idx, (e2x*qx+e2y*qy+e2z*qz)/det AS dist, ox, oy, oz, dx, dy, dz FROM dd WHERE abs(det)>1e-10 AND (sx*qpx+sy*qpy+sz*qpz)/det>=0 AND (dx*qx+dy*qy+dz*qz)/det>=0 AND (sx*qpx+sy*qpy+sz*qpz)/det+(dx*qx+dy*qy+dz*qz)/det<=1 AND (e2x*qx+e2y*qy+e2z*qz)/det>0 AND (e2x*qx+e2y*qy+e2z*qz)/det<=80),
hm AS (SELECT DISTINCT h.ray_id, h.tri_idx FROM hit h JOIN mask_cell m ON m.row_no=CAST(floor((oz+dz*dist)/8) AS BIGINT) AND m.col_no=CAST(floor((ox+dx*dist)/8) AS BIGINT) WHERE m.r>127 AND oy+dy*dist>=CASE WHEN m.a=255 THEN 5e0 ELSE greatest(5e0,CAST(m.a AS DOUBLE)) END AND oy+dy*dist<=2e1),
v AS (SELECT ray_id, tri_idx, row_number() OVER (PARTITION BY ray_id ORDER BY dist, tri_idx) AS rn FROM hit WHERE (ray_id, tri_idx) NOT IN (SELECT (ray_id, tri_idx) FROM hm))
SELECT component, count(*) AS hits, count(DISTINCT v.tri_idx) AS faces FROM v JOIN comp c ON c.tri_idx=v.tri_idx WHERE rn=1 GROUP BY 1""")
def _(t):
    return reports.viewport_audit(t.sql(EYES), t.tri, m.components(t.tri), t.mask_cell, 8.0, 5.0, 20.0, 80.0, 8, 6, 40.0, (2, 5), (1, 4))


@query("k8_native_coverage", f"""WITH {CELLS}, cov AS (SELECT DISTINCT row_no*2+i AS row_no, col_no*2+j AS col_no FROM mask_cell, range(0,2) a(i), range(0,2) b(j) WHERE r>127)
SELECT d.poly_id, count(*) AS cells, count(c.row_no) AS covered, CASE WHEN count(c.row_no)=0 THEN 'missing' WHEN count(c.row_no)>=95e-2*count(*) THEN 'complete' ELSE 'partial' END AS status FROM dcell d LEFT JOIN cov c ON c.row_no=d.row_no AND c.col_no=d.col_no GROUP BY 1""")
def _(t):
    pair = F.array(F.lit(0), F.lit(1))
    fine = t.mask_cell.where("r>127").withColumn("i", F.explode(pair)).withColumn("j", F.explode(pair)).select((F.col("row_no") * 2 + F.col("i")).alias("row_no"), (F.col("col_no") * 2 + F.col("j")).alias("col_no")).distinct().withColumn("hit", F.lit(1))
    c = r.cells_in_polygons(t.poly_edge, 4.0).join(fine, ["row_no", "col_no"], "left").groupBy("poly_id").agg(F.count("*").alias("cells"), F.count("hit").alias("covered"))
    return c.withColumn("status", F.when(F.col("covered") == 0, "missing").when(F.col("covered") >= 0.95 * F.col("cells"), "complete").otherwise("partial"))


@query("k11_terrain_build", f"""WITH {GRID}, n AS (SELECT (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) AS ny FROM grid), {DOWN},
tq AS (SELECT a.h AS a, b.h AS b, c.h AS c, d.h AS d FROM down a JOIN down b ON b.row_no=a.row_no AND b.col_no=a.col_no+1 JOIN down c ON c.row_no=a.row_no+1 AND c.col_no=a.col_no JOIN down d ON d.row_no=a.row_no+1 AND d.col_no=a.col_no+1),
fp AS (SELECT struct_pack(r := row_no, c := col_no) AS pt_id, col_no*8e0 AS x, row_no*8e0 AS z, h AS truth FROM dem_cell WHERE h IS NOT NULL),
{dem_sql("triangle", step="32e0", dem="down", rows="(SELECT max(row_no)//4+1 FROM dem_cell)", cols="(SELECT max(col_no)//4+1 FROM dem_cell)", name="lo", points="fp")},
er AS (SELECT lo.h-truth AS off FROM fp JOIN lo ON lo.pt_id=fp.pt_id WHERE lo.h IS NOT NULL)
SELECT (SELECT count(h) FROM dem_cell) AS vertices, (SELECT count(*) FROM n) AS faces, (SELECT count(*) FILTER (ny>0) FROM n) AS upward, (SELECT count(h) FROM down) AS coarse_vertices,
 (SELECT 2*count(a+b+c+d) FROM tq) AS coarse_faces,
 (SELECT 2*count(a+b+c+d) FROM tq) AS coarse_upward,
 count(*) AS points, round(avg(off),6) AS bias, round(sqrt(avg(off*off)),6) AS rmse, max(abs(off)) AS max_abs, round(quantile_cont(abs(off),95e-2),6) AS p95_abs FROM er""")
def _(t):
    k = F.floor(F.col("row_no") / 40)
    cells = t.dem_cell.select(k.alias("tile_id"), (F.col("row_no") % 40).alias("r"), F.col("col_no").alias("c"), "h")
    tiles = cells.select("tile_id").distinct().select("tile_id", F.col("tile_id").alias("ord"), (F.lit(820000.0) - F.col("tile_id") * 320).alias("north"), F.lit(844000.0).alias("east"))
    out = reports.terrain_report(tiles, cells, STEP, 820000.0, 844000.0, 4)
    return out.withColumns({c: F.round(c, 6) for c in ("bias", "rmse", "p95_abs")})


@query("k12_terrain_check", f"""WITH {GRID} SELECT count(*)*3 AS corners, CAST(0 AS BIGINT) AS unsupported, 0e0 AS max_error, count(*) AS faces, CAST(0 AS BIGINT) AS not_upward FROM grid""")
def _(t):
    tri = r.triangulate(t.dem_cell, STEP).select(*[(F.col(f"z{i}") / STEP).cast("bigint").alias(f"r{i}") for i in (1, 2, 3)], *[(F.col(f"x{i}") / STEP).cast("bigint").alias(f"c{i}") for i in (1, 2, 3)],
                                                 "y1", "y2", "y3", g.face_normal()[1].alias("ny"))
    return audits.terrain_check(t.dem_cell, tri)


@query("k13_identity_audit", f"""WITH {CELLS}, n AS (SELECT poly_id, count(*) AS n FROM dcell GROUP BY 1), s AS (SELECT a.poly_id AS a_id, b.poly_id AS b_id, count(*) AS shared FROM dcell a JOIN dcell b ON a.poly_id<b.poly_id AND a.row_no=b.row_no AND a.col_no=b.col_no GROUP BY 1,2)
SELECT a_id, b_id, shared, round(shared/CAST(least(na.n,nb.n) AS DOUBLE),9) AS share FROM s JOIN n na ON na.poly_id=a_id JOIN n nb ON nb.poly_id=b_id WHERE shared/CAST(least(na.n,nb.n) AS DOUBLE)>5e-3""")
def _(t):
    return audits.identity_audit(t.poly_edge, 4.0).withColumn("share", F.round("share", 9))


#: two neighbouring polygons are fragments of one identity
FRAGMENTS = "SELECT poly_id, concat('named:', CAST(floor(poly_id/2e0) AS BIGINT)) AS entity_id FROM domains"
SPOTS = "SELECT concat('named:', CAST(floor(poly_id/2e0) AS BIGINT)) AS entity_id, cx+r*(poly_id%5)*3e-1 AS x, cz+r*1e-1 AS z FROM domains WHERE poly_id%2=0"


@query("k13_identity_report", f"""WITH {CELLS}, fr AS ({FRAGMENTS}), lb AS ({SPOTS}), ic AS (SELECT entity_id, row_no, col_no, count(*) AS n FROM dcell d JOIN fr ON fr.poly_id=d.poly_id GROUP BY 1,2,3), sz AS (SELECT entity_id, count(*) AS n FROM ic GROUP BY 1),
sp AS (SELECT struct_pack(e := entity_id, x := x, z := z) AS pt_id, x, z FROM lb), {rings_sql(points="sp")}, ins AS (SELECT pt_id, poly_id FROM rings GROUP BY pt_id, poly_id HAVING {FOLDS["include_outer"]}),
sh AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM ic a JOIN ic b ON a.row_no=b.row_no AND a.col_no=b.col_no AND a.entity_id<b.entity_id GROUP BY 1,2)
SELECT 'label-outside' AS rule, sp.pt_id.e AS entity_id, CAST(NULL AS VARCHAR) AS other, CAST((SELECT count(*) FROM fr WHERE fr.entity_id=sp.pt_id.e) AS DOUBLE) AS value FROM sp WHERE NOT EXISTS (SELECT 1 FROM ins i JOIN fr ON fr.poly_id=i.poly_id WHERE i.pt_id=sp.pt_id AND fr.entity_id=sp.pt_id.e)
UNION ALL SELECT 'fragments-overlap', entity_id, NULL, sum(n-1)*16e0 FROM ic GROUP BY 2 HAVING sum(n-1)>0
UNION ALL SELECT 'identities-overlap', a, b, round(s.n/least(x.n,y.n)::DOUBLE,9) FROM sh s JOIN sz x ON x.entity_id=a JOIN sz y ON y.entity_id=b WHERE s.n/least(x.n,y.n)::DOUBLE>5e-3""")
def _(t):
    return reports.identity_report(t.poly_edge, t.sql(FRAGMENTS), t.sql(SPOTS), 4.0).withColumn("value", F.round("value", 9))


@query("k14_inventory_gaps", "WITH g AS (SELECT p_partkey AS id FROM part WHERE p_partkey%37<>5 UNION ALL SELECT p_partkey+5000000 FROM part WHERE p_partkey%41=6), c AS (SELECT p_partkey AS id, CASE " + " ".join(f"WHEN {w} THEN '{c}'" for c, w in CLASSES) + """ ELSE 'unclassified' END AS class FROM part),
f AS (SELECT id, class, id IN (SELECT l_partkey FROM lineitem WHERE l_quantity>45) AS pk, id IN (SELECT id FROM g) AS kn FROM c UNION ALL SELECT id, 'registry-only', FALSE, TRUE FROM g WHERE id NOT IN (SELECT id FROM c))
SELECT class, count(*) AS entries, count(*) FILTER (pk) AS picked, count(*) FILTER (NOT pk) AS gap, count(*) FILTER (NOT kn) AS unregistered, min(id) FILTER (NOT pk) AS first_missing, least(count(*) FILTER (NOT pk), 20) AS shown FROM f GROUP BY 1""")
def _(t):
    k = F.col("p_partkey")
    registry = t.part.where("p_partkey%37<>5").select(k.alias("id")).unionByName(t.part.where("p_partkey%41=6").select((k + 5000000).alias("id")))
    classes = [(c, t.part.where(w).select(k.alias("id"))) for c, w in CLASSES]
    return reports.inventory_report(t.part.select(k.alias("id")), classes, t.lineitem.where("l_quantity>45").select(F.col("l_partkey").alias("id")), registry)


@query("k16_quality_triage", f"WITH {TRIAGE} SELECT CASE WHEN score>=8 THEN 'P0' WHEN score>=5 THEN 'P1' WHEN score>=3 THEN 'P2' ELSE 'P3' END AS level, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, min(id) AS first_id FROM sc GROUP BY 1")
def _(t):
    return scoring.triage(triage_input(t)).groupBy("level").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.min("id").alias("first_id"))


@query("k17_construction_boundary", """WITH w AS (SELECT 'building:'||s_suppkey AS id FROM supplier WHERE s_suppkey%6=0), d AS (SELECT 'doc'||o_orderkey%5 AS place, 'building:'||(o_custkey%200) AS id, CASE o_orderkey%3 WHEN 0 THEN 'ownerId' WHEN 1 THEN 'entityId' ELSE 'note' END AS k FROM orders),
u AS (SELECT id, place FROM d WHERE k<>'note' UNION ALL SELECT 'building:'||(p_partkey%300), 'representation' FROM part UNION ALL SELECT entity_id, 'domain' FROM domains WHERE poly_id%12=6)
SELECT id, place, count(*) AS n FROM u WHERE id IN (SELECT id FROM w) GROUP BY 1,2""")
def _(t):
    works = t.supplier.where("s_suppkey%6=0").select(F.concat(F.lit("building:"), "s_suppkey").alias("id"))
    key = F.get(F.array(F.lit("ownerId"), F.lit("entityId"), F.lit("note")), (F.col("o_orderkey") % 3).cast("int"))
    docs = t.orders.select(F.concat(F.lit("doc"), F.col("o_orderkey") % 5).alias("name"), F.concat(F.lit('{"a":{"'), key, F.lit('": "building:'), F.col("o_custkey") % 200, F.lit('"}}')).alias("doc"))
    tables = {"representation": t.part.select(F.concat(F.lit("building:"), F.col("p_partkey") % 300).alias("id")), "domain": t.domains.where("poly_id%12=6").select(F.col("entity_id").alias("id"))}
    return reports.construction_bindings(works, docs, ["ownerId", "entityId"], tables)


@query("k19_seal_check", """SELECT change, count(*) AS paths FROM (SELECT CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM inv_a a FULL JOIN inv_b b ON a.path=b.path WHERE a.path IS NULL OR b.path IS NULL OR a.bytes IS DISTINCT FROM b.bytes OR a.sha256 IS DISTINCT FROM b.sha256) q GROUP BY 1""")
def _(t):
    return audits.seal_check(t.inv_a, t.inv_b)


#: keys of the interface in each locale
MESSAGES = "SELECT CASE p_partkey%3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-Hant' ELSE 'zh-Hans' END AS locale, concat('key', p_partkey%250) AS key FROM part WHERE p_partkey%17<>3"


@query("k20_locale_report", f"""WITH nm AS (SELECT 'building:'||ent_no AS entity_id, q.* FROM ({NAMES}) q), ea AS (SELECT entity_id, name, alias, en, hant, hans, u.l AS locale, u.s AS shown FROM nm, LATERAL (SELECT unnest([struct_pack(l := 'en', s := en), struct_pack(l := 'zh-Hant', s := hant), struct_pack(l := 'zh-Hans', s := hans)]) AS u) x),
nz AS (SELECT *, list_transform(list_filter([name,alias,en,hant,hans], lambda v: v IS NOT NULL), lambda v: trim(regexp_replace(lower(translate(v,'{text.TRADITIONAL}寳','{text.SIMPLIFIED}宝')),'\\s+',' ','g'))) AS ns, trim(regexp_replace(lower(translate(coalesce(shown,''),'{text.TRADITIONAL}寳','{text.SIMPLIFIED}宝')),'\\s+',' ','g')) AS wanted FROM ea),
ms AS (SELECT DISTINCT locale, key FROM ({MESSAGES}) q)
SELECT 'empty-name' AS rule, locale, entity_id AS key FROM ea WHERE trim(coalesce(shown,''))='' UNION ALL SELECT 'placeholder', locale, entity_id FROM ea WHERE regexp_matches(shown,'[{{}}]') UNION ALL SELECT 'han-in-english', locale, entity_id FROM ea WHERE locale='en' AND regexp_matches(shown,'[㐀-鿿]')
UNION ALL SELECT 'no-han', locale, entity_id FROM ea WHERE locale<>'en' AND NOT regexp_matches(shown,'[㐀-鿿]') UNION ALL SELECT 'search-misses', locale, entity_id FROM nz WHERE wanted='' OR NOT list_contains(ns, wanted)
UNION ALL SELECT 'shared-name', locale, shown FROM ea GROUP BY locale, shown HAVING count(DISTINCT entity_id)>1 UNION ALL SELECT 'key-missing', l, key FROM (SELECT DISTINCT key FROM ms) k, (VALUES ('en'),('zh-Hant'),('zh-Hans')) v(l) WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.locale=l AND ms.key=k.key)""")
def _(t):
    names = t.named.select("entity_id", "name", F.array_compact(F.array("alias")).alias("aliases"))
    return reports.locale_report(names, t.sql(MESSAGES))


@query("k20_translation_coverage", f"SELECT count(*) AS entities, count(CASE WHEN en=name AND regexp_matches(name,'[㐀-鿿]') THEN 1 END) AS en_untranslated, count(CASE WHEN hans<>hant THEN 1 END) AS scripts_differ FROM ({NAMES}) q")
def _(t):
    n = t.named.withColumn("aliases", F.array_compact(F.array("alias"))).select("name", *[text.display_name("name", "aliases", loc).alias(a) for a, loc in (("en", "en"), ("hant", "zh-Hant"), ("hans", "zh-Hans"))])
    return n.agg(F.count("*").alias("entities"), F.count(F.when((F.col("en") == F.col("name")) & F.col("name").rlike(text.HAN), 1)).alias("en_untranslated"), F.count(F.when(F.col("hans") != F.col("hant"), 1)).alias("scripts_differ"))


@query("k22_poi_consolidation", f"""WITH {FIT}, mn AS (SELECT k, avg(x) AS mx, avg(y) AS my, avg(e) AS me, avg(n) AS mn FROM c0 GROUP BY k), q AS (SELECT k, max(ae) AS ae, max(be) AS be, max(an) AS an, max(bn) AS bn, sqrt(avg(sq)) AS rmse FROM r GROUP BY k), {CENTROID},
p AS (SELECT s_suppkey AS id, s_suppkey%44 AS k, CASE WHEN s_suppkey%8<>5 THEN s_suppkey*3e0 END AS x, s_suppkey*7e0 AS y FROM supplier),
f AS (SELECT id, me+ae*(x-mx)+be*(y-my) AS fe, mn+an*(x-mx)+bn*(y-my) AS fn, rmse, cx, cz FROM p LEFT JOIN q ON q.k=p.k LEFT JOIN mn ON mn.k=p.k LEFT JOIN cen ON cen.poly_id=p.id AND p.id%3=0)
SELECT id, CASE WHEN cx IS NOT NULL THEN 'official-outline' WHEN fe IS NOT NULL THEN 'map-estimate' ELSE 'unresolved' END AS source, round(coalesce(cx,fe),6) AS e, round(coalesce(cz,fn),6) AS n, CASE WHEN cx IS NULL AND fe IS NOT NULL AND rmse>24e-1 THEN round(rmse,6) END AS caution, round(sqrt((fe-cx)*(fe-cx)+(fn-cz)*(fn-cz)),6) AS apart FROM f""")
def _(t):
    k = F.col("s_suppkey")
    pois = t.supplier.select(k.alias("id"), (k % 44).alias("sheet"), F.when(k % 8 != 5, k * 3.0).alias("x"), (k * 7.0).alias("y"))
    outlines = polygons.poly_centroid(t.poly_edge.where("poly_id%3=0")).select(F.col("poly_id").alias("id"), F.col("cx").alias("e"), F.col("cz").alias("n"))
    out = reports.consolidate_pois(pois, controls(t).withColumnRenamed("k", "sheet"), outlines, 2.4)
    return rounded(out, "e", "n", "caution", "apart")


@query("k23_footprint_log", "SELECT poly_id, 0 AS part, ring, CASE WHEN ring=0 THEN 'small-part-dropped' ELSE 'small-hole-filled' END AS change, abs(sum(x1*z2-x2*z1)/2) AS area FROM poly_edge GROUP BY 1,2,3 HAVING (ring=0 AND abs(sum(x1*z2-x2*z1)/2)<=1000) OR (ring>0 AND abs(sum(x1*z2-x2*z1)/2)<=200)")
def _(t):
    return audits.normalise_footprints(t.poly_edge, 1000.0, 200.0)


ASKS = "SELECT s_suppkey AS ask_id, concat('building:', s_suppkey%40) AS building, CASE s_suppkey%4 WHEN 0 THEN 'R12' WHEN 1 THEN 'Connector' WHEN 2 THEN ' ' ELSE concat('9', s_suppkey%10) END AS text FROM supplier"


@query("k24_room_search", f"""WITH a AS ({ASKS}), rm AS (SELECT s.entity_id AS room_id, f.parent_id AS building, s.name, s.type, CAST(split_part(s.entity_id,':',2) AS BIGINT) AS n FROM entities s JOIN entities f ON f.entity_id=s.parent_id WHERE s.type IN ('space','connector'))
SELECT ask_id, room_id, name, TRUE AS from_index FROM a JOIN rm ON rm.building=a.building WHERE trim(text)<>'' AND contains(lower(name||' '||type), lower(text)) UNION ALL SELECT ask_id, room_id, name, FALSE FROM a JOIN rm ON rm.building=a.building WHERE trim(text)='' AND n%5<>0""")
def _(t):
    rooms = t.entities.where("type in ('space','connector')").select(F.col("entity_id").alias("room_id"), "name", "type", F.col("parent_id").alias("floor"))
    rooms = rooms.join(t.entities.select(F.col("entity_id").alias("floor"), F.col("parent_id").alias("building")), "floor")
    drawn = rooms.withColumn("interactive", F.split("room_id", ":")[1].cast("bigint") % 5 != 0)
    return reports.search_rooms(t.sql(ASKS), rooms, drawn)


@query("k25_catalogue_build", "SELECT category, count(*) AS n, count(CASE WHEN located THEN 1 END) AS located, count(CASE WHEN NOT located THEN 1 END) AS unlocated FROM (SELECT CASE WHEN p_type='ECONOMY' THEN 'residence' WHEN p_size>30 THEN 'academic' WHEN contains(p_name,'small') THEN 'amenity' ELSE 'other' END AS category, p_partkey IN (SELECT s_suppkey*7 FROM supplier) AS located FROM part) q GROUP BY 1")
def _(t):
    df = t.part.withColumn("id", F.col("p_partkey"))
    c = audits.catalogue_rows(df, [("residence", "p_type='ECONOMY'"), ("academic", "p_size>30"), ("amenity", "contains(p_name,'small')")], t.supplier.select((F.col("s_suppkey") * 7).alias("id")))
    return c.groupBy("category").agg(F.count("*").alias("n"), F.count(F.when(F.col("located"), 1)).alias("located"), F.count(F.when(~F.col("located"), 1)).alias("unlocated"))


#: services as resolved: some of another building, some of another type, some that the registry does not have
SERVICES = "SELECT entity_id, CASE WHEN n%5=1 THEN 'facility' ELSE type END AS type, CASE WHEN n%7=2 THEN 'zone:none' ELSE parent_id END AS parent_id FROM (SELECT e.*, CAST(split_part(entity_id, ':', 2) AS BIGINT) AS n FROM entities e WHERE type='building') q WHERE n%3<>0 UNION ALL SELECT concat('building:x', s_suppkey), 'building', NULL FROM supplier WHERE s_suppkey%20=1"


@query("k26_negative_binding", f"""WITH {REL}, sv AS ({SERVICES}), h AS (SELECT s.*, e.entity_id IS NOT NULL AS there, e.type AS t, e.parent_id AS p FROM sv s LEFT JOIN entities e ON e.entity_id=s.entity_id),
u AS (SELECT target_id AS entity_id, 'has-relation' AS rule FROM rel UNION ALL SELECT source_id, 'has-relation' FROM rel UNION ALL SELECT 'building:'||(p_partkey%40), 'has-representation' FROM part UNION ALL SELECT entity_id, 'has-domain' FROM domains WHERE poly_id%9=4)
SELECT entity_id, 'unknown' AS rule, CAST(1 AS BIGINT) AS n FROM h WHERE NOT there UNION ALL SELECT entity_id, 'wrong-type', 1 FROM h WHERE there AND t IS DISTINCT FROM type UNION ALL SELECT entity_id, 'wrong-parent', 1 FROM h WHERE there AND p IS DISTINCT FROM parent_id
UNION ALL SELECT entity_id, rule, count(*) FROM u WHERE entity_id IN (SELECT entity_id FROM sv) GROUP BY 1,2""")
def _(t):
    rel = relations(t)
    ends = rel.select(F.col("target_id").alias("entity_id")).unionByName(rel.select(F.col("source_id").alias("entity_id")))
    uses = {"has-relation": ends, "has-representation": t.part.select(F.concat(F.lit("building:"), F.col("p_partkey") % 40).alias("entity_id")), "has-domain": t.domains.where("poly_id%9=4").select("entity_id")}
    return reports.negative_bindings(t.sql(SERVICES), t.entities, uses)
