"""Source bodies: slices of their support, interfaces and clearances."""

from pyspark.sql import functions as F

from landfold.catalogue import mesh as meshq, query
from landfold.catalogue.raster import hits_sql
from landfold.catalogue.spatial import inside_sql
from landfold.operators import bodies, mesh as m
from landfold.plans.gridjoin import spread
from landfold.session import cut_lineage

PIXEL = 8.0

#: the clipped polygon as a list of vertices, fanned into faces; parts by following neighbours from cell to cell
CLIPPED = """lv AS (SELECT tile_id AS body, q AS slice, min(least(y1,y2,y3))+(max(greatest(y1,y2,y3))-min(least(y1,y2,y3)))*q AS cut_y FROM tri, (VALUES (25e-2),(5e-1),(75e-2)) s(q) GROUP BY 1,2),
fc AS (SELECT body, slice, cut_y, tri_idx, [struct_pack(x := x1, y := y1, z := z1), struct_pack(x := x2, y := y2, z := z2), struct_pack(x := x3, y := y3, z := z3)] AS v FROM tri JOIN lv ON lv.body=tri.tile_id),
cv AS (SELECT *, list_filter(flatten([[CASE WHEN v[i].y>=cut_y THEN v[i] END, CASE WHEN (v[i].y>=cut_y)<>(v[i%3+1].y>=cut_y) THEN struct_pack(x := v[i].x+(v[i%3+1].x-v[i].x)*((cut_y-v[i].y)/(v[i%3+1].y-v[i].y)), y := v[i].y+(v[i%3+1].y-v[i].y)*((cut_y-v[i].y)/(v[i%3+1].y-v[i].y)), z := v[i].z+(v[i%3+1].z-v[i].z)*((cut_y-v[i].y)/(v[i%3+1].y-v[i].y))) END] FOR i IN range(1,4)]), lambda p: p IS NOT NULL) AS p FROM fc),
ca AS (SELECT *, abs(list_sum([p[i].x*p[i%len(p)+1].z-p[i%len(p)+1].x*p[i].z FOR i IN range(1,len(p)+1)]))/2 AS plan FROM cv WHERE len(p)>=3),
cp AS (SELECT * FROM ca WHERE plan>1e-9),
fn AS (SELECT struct_pack(body := body, slice := slice) AS tile_id, tri_idx, p[1].x AS x1, p[1].y AS y1, p[1].z AS z1, p[k].x AS x2, p[k].y AS y2, p[k].z AS z2, p[k+1].x AS x3, p[k+1].y AS y3, p[k+1].z AS z3 FROM cp, range(2,4) r(k) WHERE k<len(p))"""


@query("e34_slice_support", f"""WITH RECURSIVE {CLIPPED}, {hits_sql("fn", step="5e-1")}, cl AS (SELECT DISTINCT tile_id.body AS body, tile_id.slice AS slice, row_no, col_no FROM hits),
nb AS (SELECT a.body, a.slice, a.row_no*1000000+a.col_no AS u, b.row_no*1000000+b.col_no AS v FROM cl a JOIN cl b ON a.body=b.body AND a.slice=b.slice AND ((a.row_no=b.row_no AND abs(a.col_no-b.col_no)=1) OR (a.col_no=b.col_no AND abs(a.row_no-b.row_no)=1))),
rc AS (SELECT body, slice, row_no*1000000+col_no AS u, row_no*1000000+col_no AS v FROM cl UNION SELECT r.body, r.slice, r.u, n.v FROM rc r JOIN nb n ON n.body=r.body AND n.slice=r.slice AND n.u=r.v),
cm AS (SELECT body, slice, c, count(*)*25e-2 AS size FROM (SELECT body, slice, u, min(v) AS c FROM rc GROUP BY 1,2,3) q GROUP BY 1,2,3),
pa AS (SELECT body, slice, sum(size) AS area, count(*) AS parts, count(*) FILTER (size>1) AS large_parts, max(size) AS largest FROM cm GROUP BY 1,2),
fa AS (SELECT body, slice, count(*) AS faces, sum(plan) AS clipped FROM cp GROUP BY 1,2)
SELECT lv.body, lv.slice, cut_y, coalesce(faces,0) AS faces, round(coalesce(clipped,0),6) AS clipped_area, CAST(coalesce(area,0)*4 AS BIGINT) AS cells, coalesce(area,0e0) AS area, coalesce(parts,0) AS parts, coalesce(large_parts,0) AS large_parts, coalesce(largest,0e0) AS largest
FROM lv LEFT JOIN fa ON fa.body=lv.body AND fa.slice=lv.slice LEFT JOIN pa ON pa.body=lv.body AND pa.slice=lv.slice""")
def _(t):
    return bodies.slice_support(t.tri, "tile_id", 0.5, large=1.0).withColumn("clipped_area", F.round("clipped_area", 6))


@query("d37_body_interface", f"""WITH ce AS (SELECT mask_id AS body, row_no, col_no, CAST(g AS DOUBLE) AS y FROM mask_cell), sp AS (SELECT body, min(y) AS foot, max(y) AS top FROM ce GROUP BY 1),
pr AS (SELECT a.body AS a, b.body AS b, b.foot, a.top-b.foot AS level_step FROM sp a JOIN sp b ON a.body<>b.body),
lo AS (SELECT p.a, p.b, p.foot, row_no, col_no, y FROM pr p JOIN ce ON body=a), up AS (SELECT p.a, p.b, p.foot, row_no, col_no, y FROM pr p JOIN ce ON body=b),
bo AS (SELECT coalesce(l.a,u.a) AS a, coalesce(l.b,u.b) AS b, l.y AS ya, u.y AS yb FROM lo l FULL JOIN up u ON u.a=l.a AND u.b=l.b AND u.row_no=l.row_no AND u.col_no=l.col_no),
pl AS (SELECT a, b, count(ya-yb)*64e0 AS shared_area, count(*) FILTER (yb IS NULL)*64e0 AS only_a, count(*) FILTER (ya IS NULL)*64e0 AS only_b, min(ya-yb) AS min_step, max(ya-yb) AS max_step, round(avg(ya-yb),6) AS mean_step FROM bo GROUP BY 1,2),
ft AS (SELECT a, b, row_no, col_no FROM up WHERE abs(y-foot)<=4), rf AS (SELECT a, b, row_no, col_no FROM lo WHERE abs(y-foot)<=4),
ds AS (SELECT f.a, f.b, f.row_no, f.col_no, sqrt(min(pow(f.row_no-r.row_no,2)+pow(f.col_no-r.col_no,2)))*8 AS d FROM ft f JOIN rf r ON r.a=f.a AND r.b=f.b GROUP BY ALL),
qs AS (SELECT a, b, count(*) FILTER (d=0)*64e0 AS contact_area, min(d) AS distance_min, quantile_cont(d,5e-1) AS distance_median, quantile_cont(d,95e-2) AS distance_p95, max(d) AS distance_max FROM ds GROUP BY 1,2),
ctr AS (SELECT struct_pack(b := body, r := row_no, c := col_no) AS pt_id, (col_no+5e-1)*8 AS x, (row_no+5e-1)*8 AS z FROM ce), {inside_sql(points="ctr")},
ou AS (SELECT pt_id.b AS a, count(*) FILTER (pt_id NOT IN (SELECT pt_id FROM inside))*64e0 AS outside_area FROM ctr GROUP BY 1)
SELECT p.a, p.b, level_step, shared_area, only_a, only_b, min_step, max_step, mean_step, (SELECT count(*) FROM ft WHERE ft.a=p.a AND ft.b=p.b) AS foot_cells, coalesce(contact_area,0e0) AS contact_area,
 round(distance_min,6) AS distance_min, round(distance_median,6) AS distance_median, round(distance_p95,6) AS distance_p95, round(distance_max,6) AS distance_max, outside_area
FROM pr p JOIN pl ON pl.a=p.a AND pl.b=p.b LEFT JOIN qs ON qs.a=p.a AND qs.b=p.b JOIN ou ON ou.a=p.a""")
def _(t):
    cells = t.mask_cell.select(F.col("mask_id").alias("body"), "row_no", "col_no", F.col("g").cast("double").alias("y"))
    ids = cells.select("body").distinct()
    pairs = ids.select(F.col("body").alias("a")).join(ids.select(F.col("body").alias("b")), F.col("a") != F.col("b"))  # every pair of the masks, of which there are few
    out = bodies.interfaces(cells, pairs, PIXEL, t.poly_edge, band=4.0)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_step", "distance_min", "distance_median", "distance_p95", "distance_max")})


#: every face again, a little aside and 20.25 above, as bodies of its own
HUNG = "SELECT tile_id, tri_idx+1000000 AS tri_idx, x1+75e-2 AS x1, y1+2025e-2 AS y1, z1+25e-2 AS z1, x2+75e-2 AS x2, y2+2025e-2 AS y2, z2+25e-2 AS z2, x3+75e-2 AS x3, y3+2025e-2 AS y3, z3+25e-2 AS z3 FROM tri"


@query("d30_clearance", f"""WITH RECURSIVE {meshq.comp_sql()}, soup AS (SELECT t.*, c.component FROM tri t JOIN comp c ON c.tri_idx=t.tri_idx UNION ALL SELECT h.*, c.component+1000000 FROM ({HUNG}) h JOIN comp c ON c.tri_idx=h.tri_idx-1000000),
f AS (SELECT t.*, least(x1,x2,x3) AS lx, greatest(x1,x2,x3) AS hx, least(y1,y2,y3) AS ly, greatest(y1,y2,y3) AS hy, least(z1,z2,z3) AS lz, greatest(z1,z2,z3) AS hz,
  (x1+x2+x3)/3 AS mx, (y1+y2+y3)/3 AS my, (z1+z2+z3)/3 AS mz FROM soup t),
bx AS (SELECT component, min(lx) AS lx, max(hx) AS hx, min(ly) AS ly, max(hy) AS hy, min(lz) AS lz, max(hz) AS hz FROM f GROUP BY 1),
sp AS (SELECT b.component, min(sqrt(pow(greatest(0e0,f.lx-b.hx,b.lx-f.hx),2)+pow(greatest(0e0,f.ly-b.hy,b.ly-f.hy),2)+pow(greatest(0e0,f.lz-b.hz,b.lz-f.hz),2))) AS d FROM bx b JOIN f ON f.component<>b.component AND f.lx<=b.hx+30 AND b.lx<=f.hx+30 AND f.lz<=b.hz+30 AND b.lz<=f.hz+30 GROUP BY 1),
st AS (SELECT p.component, p.tri_idx, p.my-1e-2-(f.y1+((p.mx-f.x1)*(f.z3-f.z1)-(p.mz-f.z1)*(f.x3-f.x1))/den*(f.y2-f.y1)+((f.x2-f.x1)*(p.mz-f.z1)-(f.z2-f.z1)*(p.mx-f.x1))/den*(f.y3-f.y1)) AS gap
 FROM f p JOIN (SELECT *, (x2-x1)*(z3-z1)-(z2-z1)*(x3-x1) AS den FROM f) f ON f.component<>p.component AND abs(den)>=1e-14 AND p.mx BETWEEN f.lx AND f.hx AND p.mz BETWEEN f.lz AND f.hz
 WHERE ((p.mx-f.x1)*(f.z3-f.z1)-(p.mz-f.z1)*(f.x3-f.x1))/den>=0 AND ((f.x2-f.x1)*(p.mz-f.z1)-(f.z2-f.z1)*(p.mx-f.x1))/den>=0 AND ((p.mx-f.x1)*(f.z3-f.z1)-(p.mz-f.z1)*(f.x3-f.x1))/den+((f.x2-f.x1)*(p.mz-f.z1)-(f.z2-f.z1)*(p.mx-f.x1))/den<=1),
g AS (SELECT component, tri_idx, min(gap) FILTER (gap>0) AS gap FROM st GROUP BY 1,2)
SELECT f.component, round(any_value(CASE WHEN sp.d<=30 THEN sp.d END),6) AS separation, round(min(g.gap),6) AS gap_below, count(*) AS samples, count(*)-count(g.gap) AS open_samples FROM f LEFT JOIN g ON g.tri_idx=f.tri_idx LEFT JOIN sp ON sp.component=f.component GROUP BY 1""")
def _(t):
    # As in the SQL, copies have their faces' components: from a million faces on, their indices are also those of other faces.
    comp = cut_lineage(m.components(t.tri))
    own = t.tri.select("tile_id", "tri_idx", *[f"{a}{i}" for i in (1, 2, 3) for a in "xyz"]).join(spread(comp), "tri_idx")
    hung = t.sql(HUNG).join(spread(comp.select((F.col("tri_idx") + 1000000).alias("tri_idx"), (F.col("component") + 1000000).alias("component"))), "tri_idx")
    tri = cut_lineage(own.unionByName(hung))
    return bodies.clearance(tri, 30.0).withColumns({c: F.round(c, 6) for c in ("separation", "gap_below")})
