"""Terrain grids, masks and rasterised triangles."""

import uuid

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.catalogue.scalars import NORMAL
from landfold.catalogue.spatial import inside_sql
from landfold.functions import geometry as g
from landfold.operators import polygons, raster as r
from landfold.session import checkpoint_dir
from landfold.sources import releases

STEP = 8.0
DIM = "(SELECT side FROM demdim)"


def dem_rows(t):
    return t.dem_side


@query("a7_mosaic", """WITH c AS (SELECT CAST(floor(row_no/40e0) AS BIGINT) AS ord, row_no, col_no, h FROM dem_cell UNION ALL SELECT CAST(floor(row_no/40e0) AS BIGINT)-1, row_no, col_no, h+5e-1 FROM dem_cell WHERE row_no%40<2 AND row_no>=40)
SELECT row_no, col_no, arg_max(h, ord) AS h FROM (SELECT row_no, col_no, h, ord FROM c) q WHERE ord = (SELECT max(c2.ord) FROM c c2 WHERE c2.row_no=q.row_no AND c2.col_no=q.col_no) AND h IS NOT NULL GROUP BY 1,2
UNION ALL SELECT row_no, col_no, NULL FROM dem_cell WHERE h IS NULL""")
def _(t):
    k = F.floor(F.col("row_no") / 40)
    base = t.dem_cell.select(k.alias("tile_id"), (F.col("row_no") % 40).alias("r"), F.col("col_no").alias("c"), "h")
    seam = t.dem_cell.where("row_no%40<2 and row_no>=40").select((k - 1).alias("tile_id"), (F.col("row_no") % 40 + 40).alias("r"), F.col("col_no").alias("c"), (F.col("h") + 0.5).alias("h"))
    cells = base.unionByName(seam)
    tiles = base.select("tile_id").distinct().select("tile_id", F.col("tile_id").alias("ord"), (F.lit(820000.0) - F.col("tile_id") * 320).alias("north"), F.lit(844000.0).alias("east"))
    return r.mosaic(tiles, cells, STEP, 820000.0, 844000.0)


@query("a8_tile_grid", """WITH a AS (SELECT row_no, col_no, h, tr, tc FROM dem_cell, range(-1,2) x(dr), range(-1,2) y(dc), LATERAL (SELECT CAST(floor(row_no/25e0) AS BIGINT)+dr AS tr, CAST(floor(col_no/25e0) AS BIGINT)+dc AS tc) l
 WHERE tr>=0 AND tc>=0 AND row_no BETWEEN tr*25-1 AND tr*25+25 AND col_no BETWEEN tc*25-1 AND tc*25+25),
b AS (SELECT *, row_no BETWEEN tr*25 AND tr*25+24 AND col_no BETWEEN tc*25 AND tc*25+24 AS core FROM a)
SELECT tr AS tile_row, tc AS tile_col, count(CASE WHEN core THEN 1 END) AS core_cells, count(CASE WHEN NOT core THEN 1 END) AS halo_cells, count(CASE WHEN core THEN h END) AS valid, count(CASE WHEN core THEN h END)=0 AS skipped FROM b GROUP BY 1,2 HAVING count(CASE WHEN core THEN 1 END)>0""")
def _(t):
    return r.tile_summary(r.tile_grid(t.dem_cell, n=25))


#: every cell with the tiles of 25 by 25 that it is in, as core or halo
TILED = """td AS (SELECT row_no, col_no, h, tr, tc, row_no BETWEEN tr*25 AND tr*25+24 AND col_no BETWEEN tc*25 AND tc*25+24 AS core FROM dem_cell, range(-1,2) x(dr), range(-1,2) y(dc), LATERAL (SELECT CAST(floor(row_no/25e0) AS BIGINT)+dr AS tr, CAST(floor(col_no/25e0) AS BIGINT)+dc AS tc) l
 WHERE row_no BETWEEN tr*25-1 AND tr*25+25 AND col_no BETWEEN tc*25-1 AND tc*25+25), tiled AS (SELECT * FROM td t WHERE EXISTS (SELECT 1 FROM td o WHERE o.tr=t.tr AND o.tc=t.tc AND o.core AND o.h IS NOT NULL))"""


def exported(t):
    return releases.export_tiles(r.tile_grid(t.dem_cell, n=25), f"{checkpoint_dir(t.spark).rstrip('/')}/landfold-tiles-{uuid.uuid4().hex}")


@query("a8_tile_export", f"WITH {TILED} SELECT tr AS tile_row, tc AS tile_col, row_no, col_no, h, core FROM tiled")
def _(t):
    return exported(t).select("tile_row", "tile_col", "row_no", "col_no", "h", "core")


#: faults planted in exported tiles: a wrong height in all, one in the halo alone, a lost cell, a hole, a cell that is not there
PLANTED = """SELECT tile_row, tile_col, row_no, CASE WHEN (row_no*137+col_no)%2003=11 THEN col_no+100000 ELSE col_no END AS col_no, core,
    CASE WHEN (row_no*131+col_no)%1009=7 THEN h+25e-2 WHEN NOT core AND (row_no*17+col_no*5)%401=3 THEN h-5e-1 WHEN (row_no*139+col_no)%1511=1 THEN NULL ELSE h END AS h
    FROM {0} WHERE NOT ((row_no*149+col_no)%1201=5 AND core)"""


@query("k12_tile_check", f"""WITH {TILED}, ok AS (SELECT tr AS tile_row, tc AS tile_col, * EXCLUDE (tr, tc) FROM tiled), bad AS ({PLANTED.format("ok")}),
 j AS (SELECT b.*, d.h AS truth, d.row_no IS NOT NULL AS known FROM bad b LEFT JOIN dem_cell d ON d.row_no=b.row_no AND d.col_no=b.col_no)
SELECT CASE WHEN NOT known THEN 'outside-grid' WHEN (h IS NULL)<>(truth IS NULL) THEN 'no-data-differs' ELSE 'cell-differs' END AS rule, tile_row, tile_col, row_no, col_no, abs(h-truth) AS difference FROM j WHERE NOT known OR (h IS NULL)<>(truth IS NULL) OR h<>truth
UNION ALL SELECT 'seam-differs', CAST(floor(row_no/25e0) AS BIGINT), CAST(floor(col_no/25e0) AS BIGINT), row_no, col_no, max(h)-min(h) FROM bad GROUP BY row_no, col_no HAVING max(h)>min(h)
UNION ALL SELECT 'cell-missing', CAST(floor(row_no/25e0) AS BIGINT), CAST(floor(col_no/25e0) AS BIGINT), row_no, col_no, NULL FROM dem_cell d WHERE h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.row_no=d.row_no AND b.col_no=d.col_no AND b.core)""")
def _(t):
    exported(t).createOrReplaceTempView("landfold_tiles")
    return r.tile_violations(t.spark.sql(PLANTED.format("landfold_tiles")), t.dem_cell, n=25)


def dem_sql(mode="bilinear", step="8e0", dem="dem_cell", rows=DIM, cols=DIM, name="dem", points="pts"):
    h = ("(a*(1-u)+b*u)*(1-v)+(d*(1-u)+e*u)*v" if mode == "bilinear" else "CASE WHEN a+b+d+e IS NULL THEN NULL WHEN u+v<=1 THEN a+(b-a)*u+(d-a)*v ELSE e+(d-e)*(1-u)+(b-e)*(1-v) END")
    return f"""{name}_k AS (SELECT pt_id, x/{step} AS c, z/{step} AS r, least(CAST(floor(x/{step}) AS BIGINT),{cols}-2) AS c0, least(CAST(floor(z/{step}) AS BIGINT),{rows}-2) AS r0 FROM {points}),
 {name} AS (SELECT pt_id, {h} AS h FROM (SELECT k.pt_id, c-c0 AS u, r-r0 AS v, a.h AS a, b.h AS b, d.h AS d, e.h AS e FROM {name}_k k
  LEFT JOIN {dem} a ON a.row_no=r0 AND a.col_no=c0 LEFT JOIN {dem} b ON b.row_no=r0 AND b.col_no=c0+1 LEFT JOIN {dem} d ON d.row_no=r0+1 AND d.col_no=c0 LEFT JOIN {dem} e ON e.row_no=r0+1 AND e.col_no=c0+1
  WHERE c>=0 AND r>=0 AND c<={cols}-1 AND r<={rows}-1) q)"""


for _m in ("bilinear", "triangle"):
    query(f"d25_sample_dem_{_m}", f"WITH {dem_sql(_m)} SELECT p.pt_id, d.h AS h FROM pts p LEFT JOIN dem d ON d.pt_id=p.pt_id")(
        lambda t, m=_m: r.sample_dem(t.pts, t.dem_cell, STEP, dem_rows(t), dem_rows(t), m))

DOWN = """down AS (SELECT CAST(floor(row_no/4e0) AS BIGINT) AS row_no, CAST(floor(col_no/4e0) AS BIGINT) AS col_no, CASE WHEN count(h)=16 THEN max(CASE WHEN row_no%4=0 AND col_no%4=0 THEN h END) END AS h FROM dem_cell GROUP BY 1,2)"""


@query("e18_downsample", f"WITH {DOWN} SELECT row_no, col_no, h FROM down")
def _(t):
    return r.downsample(t.dem_cell, 4)


@query("d26_surface_at", f"""WITH {DOWN}, half AS (SELECT * FROM dem_cell WHERE row_no%60<30), {dem_sql("triangle", dem="half", name="fine")}, {dem_sql("triangle", step="32e0", dem="down", rows="CAST(ceil("+DIM+"/4e0) AS BIGINT)", cols="CAST(ceil("+DIM+"/4e0) AS BIGINT)", name="coarse")},
{inside_sql()}, fl AS (SELECT i.pt_id, coalesce(max(CASE WHEN d.min_y<=p.y+1e-4 THEN d.min_y END), min(d.min_y)) AS fy FROM inside i JOIN domains d ON d.poly_id=i.poly_id JOIN pts p ON p.pt_id=i.pt_id GROUP BY 1)
SELECT p.pt_id, coalesce(fy, f.h, c.h, CASE WHEN p.pt_id%10=0 THEN 0e0 END) AS height, CASE WHEN fy IS NOT NULL THEN 'indoor' WHEN f.h IS NOT NULL THEN 'detail' WHEN c.h IS NOT NULL THEN 'terrain' WHEN p.pt_id%10=0 THEN 'water' ELSE 'unknown' END AS source
FROM pts p LEFT JOIN fl ON fl.pt_id=p.pt_id LEFT JOIN fine f ON f.pt_id=p.pt_id LEFT JOIN coarse c ON c.pt_id=p.pt_id""")
def _(t):
    n = dem_rows(t)
    small = -(-n // 4)
    fine = r.sample_dem(t.pts, t.dem_cell.where("row_no%60<30"), STEP, n, n, "triangle")
    coarse = r.sample_dem(t.pts, r.downsample(t.dem_cell, 4), 4 * STEP, small, small, "triangle")
    floors = polygons.point_in_polygon(t.pts, t.poly_edge).join(t.domains.select("poly_id", F.col("min_y").alias("floor_y")), "poly_id")
    return r.surface_at(t.pts.withColumn("water", F.col("pt_id") % 10 == 0), floors, fine, coarse)


@query("e9_error_stats", f"""WITH {DOWN}, {dem_sql("bilinear")}, {dem_sql("triangle", step="32e0", dem="down", rows="CAST(ceil("+DIM+"/4e0) AS BIGINT)", cols="CAST(ceil("+DIM+"/4e0) AS BIGINT)", name="coarse")},
e AS (SELECT c.h-d.h AS e FROM dem d JOIN coarse c ON c.pt_id=d.pt_id WHERE c.h-d.h IS NOT NULL)
SELECT count(*) AS n, round(avg(e),9) AS mean, round(avg(abs(e)),9) AS mae, round(sqrt(avg(e*e)),9) AS rmse, round(quantile_cont(abs(e),5e-1),9) AS p50, round(quantile_cont(abs(e),95e-2),9) AS p95, round(quantile_cont(abs(e),99e-2),9) AS p99, max(abs(e)) AS max FROM e""")
def _(t):
    n = dem_rows(t)
    small = -(-n // 4)
    a = r.sample_dem(t.pts, t.dem_cell, STEP, n, n, name="truth")
    b = r.sample_dem(t.pts, r.downsample(t.dem_cell, 4), 4 * STEP, small, small, "triangle", name="est")
    return r.error_stats(a.join(b, "pt_id"), "est", "truth")


@query("e10_profile", """WITH v AS (SELECT h AS v FROM dem_cell WHERE h IS NOT NULL), s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v,[1e-2,5e-2,25e-2,5e-1,75e-2,95e-2,99e-2]) AS q FROM v)
SELECT 'count' AS stat, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'min', lo FROM s UNION ALL SELECT 'max', hi FROM s
UNION ALL SELECT unnest(['p01','p05','p25','p50','p75','p95','p99']), round(unnest(q),9) FROM s UNION ALL SELECT 'bin:'||CAST(floor(v) AS BIGINT), CAST(count(*) AS DOUBLE) FROM v GROUP BY floor(v)""")
def _(t):
    return r.profile(t.dem_cell, "h")


@query("e19_extrema", """SELECT min(h) AS low, (SELECT row_no FROM dem_cell WHERE h IS NOT NULL ORDER BY h, row_no, col_no LIMIT 1) AS low_row, (SELECT col_no FROM dem_cell WHERE h IS NOT NULL ORDER BY h, row_no, col_no LIMIT 1) AS low_col,
max(h) AS high, (SELECT row_no FROM dem_cell WHERE h IS NOT NULL ORDER BY h DESC, row_no, col_no LIMIT 1) AS high_row, (SELECT col_no FROM dem_cell WHERE h IS NOT NULL ORDER BY h DESC, row_no, col_no LIMIT 1) AS high_col FROM dem_cell""")
def _(t):
    return r.extrema(t.dem_cell)


GRID = """quad AS (SELECT a.row_no, a.col_no, a.h AS nw, b.h AS ne, c.h AS sw, d.h AS se FROM dem_cell a JOIN dem_cell b ON b.row_no=a.row_no AND b.col_no=a.col_no+1 JOIN dem_cell c ON c.row_no=a.row_no+1 AND c.col_no=a.col_no
 JOIN dem_cell d ON d.row_no=a.row_no+1 AND d.col_no=a.col_no+1 WHERE a.h+b.h+c.h+d.h IS NOT NULL),
grid AS (SELECT row_no, col_no, 0 AS half, col_no*8e0 AS x1, nw AS y1, row_no*8e0 AS z1, col_no*8e0 AS x2, sw AS y2, (row_no+1)*8e0 AS z2, (col_no+1)*8e0 AS x3, ne AS y3, row_no*8e0 AS z3 FROM quad
 UNION ALL SELECT row_no, col_no, 1, (col_no+1)*8e0, ne, row_no*8e0, col_no*8e0, sw, (row_no+1)*8e0, (col_no+1)*8e0, se, (row_no+1)*8e0 FROM quad)"""


@query("e20_triangulate", f"WITH {GRID} SELECT * FROM grid")
def _(t):
    return r.triangulate(t.dem_cell, STEP)


@query("e21_vertex_normals", f"""WITH {GRID}, n AS (SELECT *, (y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) AS nx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) AS ny, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS nz FROM grid),
v AS (SELECT x1 AS x, y1 AS y, z1 AS z, nx, ny, nz FROM n UNION ALL SELECT x2,y2,z2,nx,ny,nz FROM n UNION ALL SELECT x3,y3,z3,nx,ny,nz FROM n),
s AS (SELECT x,y,z,sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM v GROUP BY 1,2,3)
SELECT x,y,z, round(nx/sqrt(nx*nx+ny*ny+nz*nz),6) AS nx, round(ny/sqrt(nx*nx+ny*ny+nz*nz),6) AS ny, round(nz/sqrt(nx*nx+ny*ny+nz*nz),6) AS nz FROM s""")
def _(t):
    return r.vertex_normals(r.triangulate(t.dem_cell, STEP))


def hits_sql(tri="tri", name="hits", step="1e0"):
    return f"""{name} AS (SELECT tile_id, tri_idx, row_no, col_no, y1+u*(y2-y1)+v*(y3-y1) AS y, ny FROM (SELECT *, (dx*(z3-z1)-dz*(x3-x1))/den AS u, ((x2-x1)*dz-(z2-z1)*dx)/den AS v FROM (
 SELECT t.*, w.w AS row_no, c.c AS col_no, (c.c+5e-1)*{step}-x1 AS dx, (w.w+5e-1)*{step}-z1 AS dz, (x2-x1)*(z3-z1)-(z2-z1)*(x3-x1) AS den,
  abs((z2-z1)*(x3-x1)-(x2-x1)*(z3-z1))/sqrt(pow((y2-y1)*(z3-z1)-(z2-z1)*(y3-y1),2)+pow((z2-z1)*(x3-x1)-(x2-x1)*(z3-z1),2)+pow((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1),2)) AS ny
 FROM {tri} t, LATERAL (SELECT unnest(range(CAST(floor(least(x1,x2,x3)/{step}) AS BIGINT)-1, CAST(ceil(greatest(x1,x2,x3)/{step}) AS BIGINT)+2)) AS c) c, LATERAL (SELECT unnest(range(CAST(floor(least(z1,z2,z3)/{step}) AS BIGINT)-1, CAST(ceil(greatest(z1,z2,z3)/{step}) AS BIGINT)+2)) AS w) w) q
 WHERE abs(den)>=1e-14) q2 WHERE u>=-1e-9 AND v>=-1e-9 AND u+v<=1+1e-9)"""


@query("d7_triangles_to_cells", f"WITH {hits_sql()} SELECT tile_id, tri_idx, row_no, col_no, round(y,6) AS y, round(ny,6) AS ny FROM hits")
def _(t):
    return r.triangles_to_cells(t.tri, 1.0).withColumns({"y": F.round("y", 6), "ny": F.round("ny", 6)})


@query("e15_top_surface", f"""WITH {hits_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY row_no, col_no ORDER BY y DESC, tile_id, tri_idx) AS rn, count(*) OVER (PARTITION BY row_no, col_no) AS hits FROM hits WHERE ny>=6e-1)
SELECT row_no, col_no, round(y,6) AS y, tile_id, tri_idx, hits FROM k WHERE rn=1""")
def _(t):
    return r.top_surface(r.triangles_to_cells(t.tri, 1.0)).withColumn("y", F.round("y", 6))


@query("e16_matched_ground", f"""WITH {hits_sql()}, k AS (SELECT *, abs(y-(row_no*col_no%40)) AS delta FROM hits WHERE ny>=6e-1), m AS (SELECT *, row_number() OVER (PARTITION BY row_no, col_no ORDER BY delta, tile_id, tri_idx) AS rn FROM k WHERE delta<=8)
SELECT row_no, col_no, round(y,6) AS y, tile_id, tri_idx, round(delta,6) AS delta FROM m WHERE rn=1""")
def _(t):
    hits = r.triangles_to_cells(t.tri, 1.0)
    ground = hits.select("row_no", "col_no").distinct().withColumn("ground", (F.col("row_no") * F.col("col_no") % 40).cast("double"))
    return r.matched_ground(hits, ground, limit=8.0).withColumns({"y": F.round("y", 6), "delta": F.round("delta", 6)})


@query("d28_handoff_cells", f"""WITH {hits_sql()} SELECT DISTINCT row_no, col_no FROM hits h WHERE tri_idx%7=0 AND NOT EXISTS (SELECT 1 FROM hits k WHERE k.tri_idx%7<>0 AND k.row_no=h.row_no AND k.col_no=h.col_no)""")
def _(t):
    return r.handoff_cells(t.tri, t.tri.where("tri_idx%7=0"), 1.0)


@query("d29_claim_cells", """WITH k AS (SELECT row_no, col_no, mask_id AS source_id, CAST(g%7 AS DOUBLE) AS error, row_number() OVER (PARTITION BY row_no, col_no ORDER BY g%7, mask_id) AS rn FROM mask_cell) SELECT row_no, col_no, source_id, error FROM k WHERE rn=1""")
def _(t):
    return r.claim_cells(t.mask_cell.select("row_no", "col_no", F.col("mask_id").alias("source_id"), (F.col("g") % 7).cast("double").alias("error")))


CELLS = """pcell AS (SELECT b.poly_id, w.w AS row_no, c.c AS col_no FROM (SELECT poly_id, min(x1) AS x0, max(x1) AS xx, min(z1) AS z0, max(z1) AS zz FROM poly_edge WHERE ring=0 GROUP BY 1) b,
 LATERAL (SELECT unnest(range(CAST(floor(x0/4) AS BIGINT), CAST(floor(xx/4) AS BIGINT)+1)) AS c) c, LATERAL (SELECT unnest(range(CAST(floor(z0/4) AS BIGINT), CAST(floor(zz/4) AS BIGINT)+1)) AS w) w),
dcell AS (SELECT p.poly_id, p.row_no, p.col_no FROM pcell p JOIN poly_edge e ON e.poly_id=p.poly_id GROUP BY 1,2,3
 HAVING sum(CASE WHEN ((e.z1>(p.row_no+5e-1)*4)<>(e.z2>(p.row_no+5e-1)*4)) AND (p.col_no+5e-1)*4 < (e.x2-e.x1)*((p.row_no+5e-1)*4-e.z1)/nullif(e.z2-e.z1,0)+e.x1 THEN 1 ELSE 0 END)%2=1)"""


@query("e11_coverage", f"""WITH {CELLS}, cov AS (SELECT DISTINCT mask_id AS level, row_no*2+i AS row_no, col_no*2+j AS col_no FROM mask_cell, range(0,2) a(i), range(0,2) b(j) WHERE r>127), n AS (SELECT poly_id, count(*) AS cells FROM dcell GROUP BY 1)
SELECT d.poly_id, c.level, count(*) AS covered, max(n.cells) AS cells, round(count(*)/CAST(max(n.cells) AS DOUBLE),9) AS ratio FROM dcell d JOIN cov c ON c.row_no=d.row_no AND c.col_no=d.col_no JOIN n ON n.poly_id=d.poly_id GROUP BY 1,2""")
def _(t):
    pair = F.array(F.lit(0), F.lit(1))
    fine = t.mask_cell.where("r>127").withColumn("i", F.explode(pair)).withColumn("j", F.explode(pair)).select(
        F.col("mask_id").alias("level"), (F.col("row_no") * 2 + F.col("i")).alias("row_no"), (F.col("col_no") * 2 + F.col("j")).alias("col_no"))
    return r.coverage(r.cells_in_polygons(t.poly_edge, 4.0), fine).withColumn("ratio", F.round("ratio", 9))


@query("d10_overlap_match", f"""WITH {CELLS}, o AS (SELECT poly_id AS b_id, row_no, col_no FROM dcell WHERE poly_id%4<>0 AND (poly_id%4<>1 OR row_no%25<>0)), s AS (SELECT a.poly_id AS a_id, o.b_id, count(*) AS shared FROM dcell a JOIN o ON o.row_no=a.row_no AND o.col_no=a.col_no GROUP BY 1,2),
na AS (SELECT poly_id, count(*) AS n FROM dcell GROUP BY 1), nb AS (SELECT b_id, count(*) AS n FROM o GROUP BY 1), f AS (SELECT s.*, shared/CAST(na.n AS DOUBLE) AS ra, shared/CAST(nb.n AS DOUBLE) AS rb FROM s JOIN na ON na.poly_id=a_id JOIN nb ON nb.b_id=s.b_id)
SELECT a_id, b_id, shared, round(ra,9) AS ratio_a, round(rb,9) AS ratio_b, ra>96e-2 AND rb>93e-2 AS owned FROM f WHERE greatest(ra,rb)>=1e-1""")
def _(t):
    a = r.cells_in_polygons(t.poly_edge, 4.0)
    b = a.where("poly_id%4<>0 and (poly_id%4<>1 or row_no%25<>0)").withColumnRenamed("poly_id", "b_id")
    m = r.overlap_match(a.withColumnRenamed("poly_id", "a_id"), b)
    return m.select("a_id", "b_id", "shared", F.round("ratio_a", 9).alias("ratio_a"), F.round("ratio_b", 9).alias("ratio_b"), "owned")


@query("e12_union_area", "SELECT mask_id%2 AS owner, count(*) AS pixels, CASE WHEN mask_id%2=0 THEN NULL ELSE count(*)*64e0 END AS area FROM (SELECT DISTINCT mask_id%2 AS mask_id, row_no, col_no FROM mask_cell) q GROUP BY mask_id")
def _(t):
    c = t.mask_cell.select((F.col("mask_id") % 2).alias("owner"), "row_no", "col_no", F.when(F.col("mask_id") == 2, 4.0).otherwise(8.0).alias("pixel"))
    return r.union_area(c, "owner", "pixel")


@query("e13_mask_or", """WITH s AS (SELECT mask_id, CASE WHEN mask_id=4 THEN 2 ELSE 1 END AS k, row_no, col_no FROM mask_cell WHERE r>127) SELECT DISTINCT row_no*k+i AS row_no, col_no*k+j AS col_no FROM s, range(0,2) a(i), range(0,2) b(j) WHERE i<k AND j<k""")
def _(t):
    k = F.when(F.col("mask_id") == 4, 2.0).otherwise(1.0)
    masks = t.mask_cell.select("mask_id").distinct().select("mask_id", F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_z"), (k * 512).alias("max_x"), (k * 512).alias("max_z"), k.alias("step"))
    return r.mask_or(t.mask_cell.where("r>127"), masks)


@query("e14_mask_merge", """SELECT row_no, col_no, max(CASE WHEN g%4=0 THEN 65535 ELSE CAST(round_even((60+mask_id)*256e0,0) AS INTEGER) END) AS upper,
 CASE WHEN min(CASE WHEN mask_id%2=0 AND a<255 THEN greatest(mask_id*2e0, CAST(a AS DOUBLE)) ELSE mask_id*2e0 END)>0 THEN CAST(floor(min(CASE WHEN mask_id%2=0 AND a<255 THEN greatest(mask_id*2e0, CAST(a AS DOUBLE)) ELSE mask_id*2e0 END)) AS INTEGER) ELSE 255 END AS lower FROM mask_cell WHERE r>127 GROUP BY 1,2""")
def _(t):
    m = F.col("mask_id")
    guards = t.mask_cell.select("mask_id").distinct().select("mask_id", (m * 2.0).alias("min_y"), (m + 60.0).alias("max_y"), (m % 2 == 0).alias("encoded"))
    cells = t.mask_cell.withColumns({"b": F.when(F.col("g") % 4 == 0, 0).otherwise(F.col("b")), "g": F.when(F.col("g") % 4 == 0, 0).otherwise(F.col("g"))})
    return r.mask_merge(cells, guards)


@query("e36_guarded_mask", """WITH ch AS (SELECT DISTINCT row_no+i AS row_no, col_no+j AS col_no FROM mask_cell, range(-1,2) a(i), range(-1,2) b(j) WHERE mask_id=1 AND r>127) SELECT p.row_no, p.col_no, p.r, CASE WHEN ch.row_no IS NULL THEN 0 ELSE p.r END AS g FROM mask_cell p LEFT JOIN ch ON ch.row_no=p.row_no AND ch.col_no=p.col_no WHERE p.mask_id=0""")
def _(t):
    return r.guarded(t.mask_cell.where("mask_id=0").drop("g"), t.mask_cell.where("mask_id=1 and r>127"))


@query("e17_merge_intervals", """WITH iv AS (SELECT o_custkey%200 AS cell, (o_orderkey%400)/4e0 AS lo, (o_orderkey%400)/4e0+(o_orderkey%9)/8e0 AS hi FROM orders),
w AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY cell ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+2e-2 THEN 1 ELSE 0 END AS st FROM iv), g AS (SELECT *, sum(st) OVER (PARTITION BY cell ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM w),
m AS (SELECT cell, isl, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY lo-hi, lo) AS rn, count(*) OVER (PARTITION BY cell)>1 AS ambiguous FROM m) SELECT cell, lo, hi, ambiguous FROM k WHERE rn=1""")
def _(t):
    iv = t.orders.select((F.col("o_custkey") % 200).alias("cell"), ((F.col("o_orderkey") % 400) / 4).alias("lo"), ((F.col("o_orderkey") % 400) / 4 + (F.col("o_orderkey") % 9) / 8).alias("hi"))
    return r.widest_interval(r.merge_intervals(iv, ["cell"]), ["cell"])


@query("e30_raster_diff", """WITH b AS (SELECT row_no, col_no, h*CASE WHEN (row_no+col_no)%5=0 THEN 2e0 ELSE 1e0 END AS h FROM dem_cell), j AS (SELECT a.row_no%3 AS region, abs(a.h-b.h) AS d, ae.h-a.h AS ga, be.h-b.h AS gb FROM dem_cell a JOIN b ON b.row_no=a.row_no AND b.col_no=a.col_no LEFT JOIN dem_cell ae ON ae.row_no=a.row_no AND ae.col_no=a.col_no+1 LEFT JOIN b be ON be.row_no=a.row_no AND be.col_no=a.col_no+1)
SELECT region, count(d) AS cells, round(avg(d),9) AS mean_abs, round(avg(CAST(d>15 AS INTEGER)),9) AS over15, round(avg(CAST(d>30 AS INTEGER)),9) AS over30, round(corr(ga,gb),6) AS gradient_corr FROM j GROUP BY 1""")
def _(t):
    b = t.dem_cell.withColumn("h", F.col("h") * F.when((F.col("row_no") + F.col("col_no")) % 5 == 0, 2.0).otherwise(1.0))
    return r.raster_diff(t.dem_cell, b, F.col("row_no") % 3)


@query("d22_seam_diffs", """WITH v AS (SELECT row_no, col_no, h FROM dem_cell UNION ALL SELECT row_no, col_no, CASE WHEN col_no%10=3 THEN h+1e-3 ELSE h END FROM dem_cell WHERE row_no%25=0 UNION ALL SELECT row_no, col_no, h FROM dem_cell WHERE col_no%25=0)
SELECT row_no, col_no, count(*) AS tiles, min(h) AS lo, max(h) AS hi, max(h)-min(h)>=1e-6 AS differs FROM v GROUP BY 1,2 HAVING count(*)>1""")
def _(t):
    d = t.dem_cell.select("row_no", "col_no", "h")
    return r.seam_diffs(d.unionByName(d.where("row_no%25=0").withColumn("h", F.when(F.col("col_no") % 10 == 3, F.col("h") + 1e-3).otherwise(F.col("h")))).unionByName(d.where("col_no%25=0")))


@query("c8_slope_class", f"WITH {NORMAL}, u AS (SELECT tri_idx, abs(ny/sqrt(nx*nx+ny*ny+nz*nz)) AS a FROM n) SELECT tri_idx, CASE WHEN a>=85e-2 THEN 'roof' WHEN a>=6e-1 THEN 'ground' WHEN a<=25e-2 THEN 'wall' ELSE 'slanted' END AS strict, CASE WHEN a>=72e-2 THEN 'roof' WHEN a>=6e-1 THEN 'ground' WHEN a<=28e-2 THEN 'wall' ELSE 'slanted' END AS loose FROM u")
def _(t):
    ny = g.normalise(g.face_normal())[1]
    return t.tri.select("tri_idx", g.slope_class(ny).alias("strict"), g.slope_class(ny, roof=0.72, wall=0.28).alias("loose"))


SAMPLE = "smp AS (SELECT p.pt_id, p.x, p.z, p.y, (p.pt_id%10)/1e1 AS ny, m.mask_id, m.r, m.g, m.b, m.a FROM pts p JOIN mask_cell m ON m.row_no=floor(p.z/8) AND m.col_no=floor(p.x/8))"


def with_ny(t):
    return t.pts.withColumn("ny", (F.col("pt_id") % 10) / 10)


@query("c9_preserved_ground", f"WITH {SAMPLE} SELECT pt_id, mask_id FROM smp WHERE r>127 AND abs(y-g-b/256e0)<=125e-2 AND ny>=6e-1")
def _(t):
    return r.mask_samples(with_ny(t), t.mask_cell, 8.0).where(r.preserved_ground()).select("pt_id", "mask_id")


@query("c10_mask_hit", f"WITH {SAMPLE} SELECT pt_id, mask_id FROM smp WHERE r>127 AND y >= CASE WHEN a=255 THEN 5e0 ELSE greatest(5e0,CAST(a AS DOUBLE)) END AND y<=4e1")
def _(t):
    return r.mask_samples(t.pts, t.mask_cell, 8.0).where(r.mask_hit(floor=5.0, cap=40.0)).select("pt_id", "mask_id")


@query("c11_preserved_structure", f"""WITH {SAMPLE}, {inside_sql("include_all")}, dr AS (SELECT DISTINCT pt_id FROM inside), q AS (SELECT s.pt_id, r-r+g-g+(r%60)>0 AND abs(y-(r%60)-g/256e0)<=1 AND ny>=6e-1 AS gr, b%8<255 AND a<255 AND y BETWEEN b%8 AND a AND d.pt_id IS NOT NULL AS st FROM smp s LEFT JOIN dr d ON d.pt_id=s.pt_id WHERE mask_id=2)
SELECT pt_id, gr AS by_ground, st AS by_structure FROM q WHERE gr OR st""")
def _(t):
    cells = t.mask_cell.where("mask_id=2").withColumns({"r": F.col("r") % 60, "b": F.col("b") % 8})
    return r.preserved_structure(with_ny(t), cells, t.poly_edge, 8.0)


@query("c14_visible_points", f"""WITH {SAMPLE}, role AS (SELECT *, CASE WHEN pt_id%2=0 THEN 'photogrammetry' ELSE 'exterior' END AS role FROM smp), kept AS (SELECT DISTINCT pt_id FROM role WHERE mask_id=4 AND r>127 AND abs(y-g-b/256e0)<=125e-2 AND ny>=6e-1),
dis AS (SELECT pt_id FROM role s WHERE r>127 AND ((role='photogrammetry' AND mask_id=0 AND y BETWEEN 0 AND 40 AND pt_id NOT IN (SELECT pt_id FROM kept)) OR (role='photogrammetry' AND mask_id=1 AND y BETWEEN 10 AND 100 AND y<=g+b/256e0+5e-1 AND ny>=6e-1) OR (role='exterior' AND mask_id=2 AND y BETWEEN 5 AND 30)))
SELECT pt_id, x, z, y FROM pts WHERE pt_id NOT IN (SELECT pt_id FROM dis)""")
def _(t):
    p = with_ny(t).withColumn("role", F.when(F.col("pt_id") % 2 == 0, "photogrammetry").otherwise("exterior"))
    rules = t.spark.createDataFrame([("photogrammetry", 0, 0.0, 40.0, True, False, 0.0), ("photogrammetry", 1, 10.0, 100.0, False, True, 0.5), ("exterior", 2, 5.0, 30.0, False, False, 0.0)],
                                    "role string, mask_id long, min_y double, max_y double, replacement boolean, encoded boolean, clearance double")
    return r.visible_points(p, t.mask_cell, rules, 8.0, ground_mask=4).select("pt_id", "x", "z", "y")
