"""Coordinate frames, matrices, codecs and per-row geometry."""

import math

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.functions import codecs, geodesy, geometry as g
from landfold.operators import frames, polygons, shaping

E0, N0 = 844800.0, 820500.0


@query("b1_local_frame", """SELECT pt_id, (844000+x)-844800 AS lx, 820500-(820000+z) AS lz, (844000+x) AS easting, (820000+z) AS northing FROM pts""")
def _(t):
    p = t.pts.select("pt_id", (F.col("x") + 844000.0).alias("easting"), (F.col("z") + 820000.0).alias("northing"))
    lx, lz = g.to_local("easting", "northing", E0, N0)
    p = p.select("pt_id", lx.alias("lx"), lz.alias("lz"))
    e, n = g.from_local("lx", "lz", E0, N0)
    return p.select("pt_id", "lx", "lz", e.alias("easting"), n.alias("northing"))


def _geodetic_sql() -> str:
    """The projection spelled out for the other engine, from the same fixed values."""
    sec = math.pi / 180 / 3600
    s = geodesy.SHIFT
    k = {"rx": s["rx"] * sec, "ry": s["ry"] * sec, "rz": s["rz"] * sec, "sc": 1 + s["ppm"] * 1e-6}
    fw, fi = geodesy.WGS84_F, geodesy.INTL24_F
    ew, ei = fw * (2 - fw), fi * (2 - fi)
    ai = geodesy.INTL24_A
    bi = ai * (1 - fi)
    ep = (ai * ai - bi * bi) / (bi * bi)
    ep2 = ei / (1 - ei)
    a0, a2, a4, a6 = geodesy.meridian_coefficients(fi)
    lat0, lon0 = math.radians(geodesy.GRID["lat0"]), math.radians(geodesy.GRID["lon0"])
    m0 = ai * (a0 * lat0 - a2 * math.sin(2 * lat0) + a4 * math.sin(4 * lat0) - a6 * math.sin(6 * lat0))
    r = repr
    d = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    return f"""
 g0 AS (SELECT pt_id, radians(lon) AS lo, radians(lat) AS la FROM geo),
 g1 AS (SELECT *, {d(geodesy.WGS84_A)}/sqrt(1-{d(ew)}*sin(la)*sin(la)) AS n FROM g0),
 g2 AS (SELECT pt_id, (n*cos(la)*cos(lo)-{d(s["tx"])})/{d(k["sc"])} AS dx, (n*cos(la)*sin(lo)-{d(s["ty"])})/{d(k["sc"])} AS dy, (n*{d(1-ew)}*sin(la)-{d(s["tz"])})/{d(k["sc"])} AS dz FROM g1),
 g3 AS (SELECT pt_id, dx+dy*{d(k["rz"])}-dz*{d(k["ry"])} AS x, dy-dx*{d(k["rz"])}+dz*{d(k["rx"])} AS y, dz+dx*{d(k["ry"])}-dy*{d(k["rx"])} AS z FROM g2),
 g4 AS (SELECT *, sqrt(x*x+y*y) AS p, atan2(z*{d(ai)}, sqrt(x*x+y*y)*{d(bi)}) AS th FROM g3),
 g5 AS (SELECT pt_id, atan2(y,x)-{d(lon0)} AS dl, atan2(z+{d(ep)}*{d(bi)}*pow(sin(th),3), p-{d(ei)}*{d(ai)}*pow(cos(th),3)) AS la FROM g4),
 g6 AS (SELECT *, {d(ai)}/sqrt(1-{d(ei)}*sin(la)*sin(la)) AS n, pow(tan(la),2) AS tt, {d(ep2)}*cos(la)*cos(la) AS cc, dl*cos(la) AS q,
   {d(ai)}*({d(a0)}*la-{d(a2)}*sin(2*la)+{d(a4)}*sin(4*la)-{d(a6)}*sin(6*la))-{d(m0)} AS m FROM g5),
 grid AS (SELECT pt_id, n*(q+(1-tt+cc)*pow(q,3)/6+(5-18*tt+tt*tt+72*cc-58*{d(ep2)})*pow(q,5)/120)+{d(geodesy.GRID["e0"])} AS e,
   m+n*tan(la)*(q*q/2+(5-tt+9*cc+4*cc*cc)*pow(q,4)/24+(61-58*tt+tt*tt+600*cc-330*{d(ep2)})*pow(q,6)/720)+{d(geodesy.GRID["n0"])} AS n FROM g6)"""


GEO = "geo AS (SELECT pt_id, 1142e-1+x/1e5 AS lon, 223e-1+z/1e5 AS lat FROM pts)"


@query("b2_geographic_to_grid", f"WITH {GEO}, {_geodetic_sql()} SELECT pt_id, round(e,3) AS easting, round(n,3) AS northing FROM grid")
def _(t):
    p = t.pts.select("pt_id", (F.lit(114.2) + F.col("x") / 1e5).alias("lon"), (F.lit(22.3) + F.col("z") / 1e5).alias("lat"))
    return geodesy.wgs84_to_grid(p, "lon", "lat").select("pt_id", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query("b3_ecef_to_local", f"WITH {GEO}, {_geodetic_sql()} SELECT g.pt_id, round(e-844800,2) AS lx, round(p.y,2) AS ly, round(820500-n,2) AS lz FROM grid g JOIN pts p ON p.pt_id=g.pt_id")
def _(t):
    lon = F.radians(F.lit(114.2) + F.col("x") / 1e5)
    lat = F.radians(F.lit(22.3) + F.col("z") / 1e5)
    ecef = dict(zip(("ex", "ey", "ez"), geodesy.geodetic_to_ecef(lon, lat, F.col("y"))))
    p = t.pts.select("pt_id", *[c.alias(n) for n, c in ecef.items()])
    p = geodesy.ecef_to_local(p, ("ex", "ey", "ez"), E0, N0)
    return p.select("pt_id", *[F.round(c, 2).alias(c) for c in ("lx", "ly", "lz")])


def _matrix(t):
    """A tile placement per part: rotation-like integers and a translation."""
    k = F.col("p_partkey")
    m = [k % 3, k % 2, F.lit(0), F.lit(0), -(k % 2), k % 3, F.lit(1), F.lit(0), F.lit(0), F.lit(-1), k % 4, F.lit(0),
         k % 50, k % 7, k % 90, F.lit(1)]
    return t.part.select(k.alias("tri_idx"), F.array(*[v.cast("double") for v in m]).alias("m"))


@query("b4_apply_matrix", """SELECT tri_idx, (tri_idx%3)*x1-(tri_idx%2)*y1+tri_idx%50 AS wx, (tri_idx%2)*x1+(tri_idx%3)*y1-z1+tri_idx%7 AS wy, y1+(tri_idx%4)*z1+tri_idx%90 AS wz FROM tri""")
def _(t):
    x, y, z = g.apply_matrix("m", "x1", "y1", "z1")
    return t.tri.join(_matrix(t), "tri_idx").select("tri_idx", x.alias("wx"), y.alias("wy"), z.alias("wz"))


@query("b5_compose_transforms", """WITH RECURSIVE tree AS (
 SELECT node_id, CAST(node_id%3+1 AS DOUBLE) AS tx, CAST(node_id%5 AS DOUBLE) AS ty, 1e0 AS s FROM lod_node WHERE parent_id IS NULL
 UNION ALL SELECT n.node_id, t.tx+t.s*(n.node_id%3+1), t.ty+t.s*(n.node_id%5), t.s*5e-1 FROM lod_node n JOIN tree t ON n.parent_id=t.node_id)
SELECT node_id, tx, ty, s AS scale FROM tree""")
def _(t):
    k = F.col("node_id")
    s = F.when(F.col("parent_id").isNull(), 1.0).otherwise(0.5)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(s, zero, zero, zero, zero, s, zero, zero, zero, zero, s, zero,
                (k % 3 + 1).cast("double"), (k % 5).cast("double"), zero, one)
    world = frames.compose_transforms(t.lod_node.select("node_id", "parent_id", m.alias("m")))
    return world.select("node_id", F.col("m")[12].alias("tx"), F.col("m")[13].alias("ty"), F.col("m")[0].alias("scale"))


@query("b6_linearise")
def _(t):
    tiles = t.domains.select(
        F.col("poly_id").alias("tile_id"),
        *[c.alias(n) for n, c in zip(("ox", "oy", "oz"), geodesy.geodetic_to_ecef(
            F.radians(F.lit(114.2) + F.col("cx") / 1e5), F.radians(F.lit(22.3) + F.col("cz") / 1e5), F.col("min_y")))],
        F.col("r").alias("radius"),
    )
    return frames.linearise(tiles, E0, N0)


@query("b7_obb_aabb", """WITH c AS (SELECT poly_id, a.v AS sx, b.v AS sy, c.v AS sz, cx, cz, r, min_y, max_y FROM domains, (VALUES (-1),(1)) a(v), (VALUES (-1),(1)) b(v), (VALUES (-1),(1)) c(v)),
p AS (SELECT poly_id, cx+sx*r*75e-2+sz*r*25e-2 AS x, (min_y+max_y)/2+sy*(max_y-min_y)/2 AS y, cz-sx*r*25e-2+sz*r*75e-2 AS z FROM c)
SELECT poly_id, 2*min(x)+5 AS min_x, 2*min(y) AS min_y, 2*min(z)-3 AS min_z, 2*max(x)+5 AS max_x, 2*max(y) AS max_y, 2*max(z)-3 AS max_z FROM p GROUP BY poly_id""")
def _(t):
    zero = F.lit(0.0)
    box = F.array(F.col("cx"), (F.col("min_y") + F.col("max_y")) / 2, F.col("cz"), F.col("r") * 0.75, zero, F.col("r") * -0.25,
                  zero, (F.col("max_y") - F.col("min_y")) / 2, zero, F.col("r") * 0.25, zero, F.col("r") * 0.75)
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 5, 0, -3, 1)])
    return frames.obb_aabb(t.domains.select("poly_id", box.alias("box"), m.alias("m")), "poly_id")


@query("b8_convex_hull", """WITH p AS (SELECT DISTINCT CAST(floor(x/64e0) AS BIGINT)*100000+CAST(floor(z/64e0) AS BIGINT) AS cell, x, z FROM pts),
-- A point is on the hull unless some directed pair (a,b) of the cell's points sees others only on its left and it is not an end: checked by hull edges.
e AS (SELECT a.cell, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM p a JOIN p b ON a.cell=b.cell AND (a.x<>b.x OR a.z<>b.z)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.cell=a.cell AND ((b.x-a.x)*(c.z-a.z)-(b.z-a.z)*(c.x-a.x) < 0
     OR ((b.x-a.x)*(c.z-a.z)-(b.z-a.z)*(c.x-a.x) = 0 AND (c.x-a.x)*(c.x-b.x)+(c.z-a.z)*(c.z-b.z) > 0))))
SELECT cell, count(*) AS vertices, round(sum(ax*bz-bx*az)/2,6) AS area FROM e GROUP BY cell""")
def _(t):
    cell = F.floor(F.col("x") / 64).cast("bigint") * 100000 + F.floor(F.col("z") / 64).cast("bigint")
    hull = frames.convex_hull(t.pts.select(cell.alias("cell"), "x", "z"), "cell")
    return frames.hull_area(hull, "cell").where("vertices >= 2")


@query("b9_quantise", "SELECT pt_id, CAST(round_even(x/3e-2,0) AS BIGINT) AS qx, CAST(round_even(y/1e-4,0) AS BIGINT) AS qy, CAST(round_even(z/5e-1,0) AS BIGINT) AS qz FROM pts")
def _(t):
    return t.pts.select("pt_id", g.quantise("x", 0.03).alias("qx"), g.quantise("y", 1e-4).alias("qy"), g.quantise("z", 0.5).alias("qz"))


@query("b10_height_codec", """SELECT pt_id, CAST(floor(floor(h*256)/256) AS INTEGER) AS hi, CAST(floor(h*256)%256 AS INTEGER) AS lo, floor(h*256)/256 AS back, CAST(floor(round_even(h*256,0)/256) AS INTEGER) AS rhi,
 CAST(round_even(h*256,0)%256 AS INTEGER) AS rlo FROM (SELECT pt_id, y+x/1e3 AS h FROM pts) q""")
def _(t):
    p = t.pts.select("pt_id", (F.col("y") + F.col("x") / 1e3).alias("h"))
    hi, lo = codecs.encode_height("h")
    rhi, rlo = codecs.encode_height("h", "round")
    return p.select("pt_id", hi.alias("hi"), lo.alias("lo"), codecs.decode_height(hi, lo).alias("back"), rhi.alias("rhi"), rlo.alias("rlo"))


@query("b11_content_id", """SELECT pt_id, substring(sha256(concat('["',pt_id,'","path','"]')),1,16) AS rep_id FROM pts""")
def _(t):
    return t.pts.select("pt_id", codecs.content_id("pt_id", F.lit("path")).alias("rep_id"))


@query("b12_mip_bytes", """SELECT p_partkey AS id, CAST(sum(4*greatest(1,CAST(floor((p_size*37)/pow(2,k)) AS BIGINT))*greatest(1,CAST(floor((p_partkey%700+1)/pow(2,k)) AS BIGINT))) AS BIGINT) AS bytes
FROM part, range(0,14) q(k) WHERE k <= floor(log2(greatest(p_size*37, p_partkey%700+1))) GROUP BY p_partkey""")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), codecs.mip_bytes(F.col("p_size") * 37, F.col("p_partkey") % 700 + 1).alias("bytes"))


@query("b13_interp", """SELECT pt_id, round(CASE WHEN y<=5 THEN 1e0 WHEN y<20 THEN 1+(y-5)*3/15 WHEN y<50 THEN 4+(y-20)*(-2e0)/30 ELSE 2e0 END,9) AS up,
 round(CASE WHEN y<=10 THEN 7e0 WHEN y<40 THEN 7+(y-10)*(-6e0)/30 ELSE 1e0 END,9) AS down FROM pts""")
def _(t):
    return t.pts.select("pt_id", F.round(g.interp("y", [5, 20, 50], [1, 4, 2]), 9).alias("up"),
                        F.round(g.interp("y", [40, 10], [1, 7]), 9).alias("down"))


@query("b14_pixel_rays", """WITH pose AS (SELECT s_suppkey AS pose_id, CAST(s_suppkey%7-3 AS DOUBLE) AS fx, CAST(-(s_suppkey%3)-1 AS DOUBLE) AS fy, CAST(s_suppkey%5+1 AS DOUBLE) AS fz FROM supplier),
f AS (SELECT pose_id, fx/sqrt(fx*fx+fy*fy+fz*fz) AS fx, fy/sqrt(fx*fx+fy*fy+fz*fz) AS fy, fz/sqrt(fx*fx+fy*fy+fz*fz) AS fz FROM pose),
r AS (SELECT *, -fz/sqrt(fz*fz+fx*fx) AS rx, 0e0 AS ry, fx/sqrt(fz*fz+fx*fx) AS rz FROM f),
u AS (SELECT *, ry*fz-rz*fy AS ux, rz*fx-rx*fz AS uy, rx*fy-ry*fx AS uz FROM r),
px AS (SELECT pose_id, CAST(c AS INTEGER) AS col_no, CAST(w AS INTEGER) AS row_no, fx, fy, fz, rx, ry, rz, ux, uy, uz, ((c+5e-1)/64*2-1)*tan(radians(25e0))*64/48 AS a, (1-(w+5e-1)/48*2)*tan(radians(25e0)) AS b FROM u, range(20,24) q(c), range(10,13) s(w)),
d AS (SELECT *, fx+a*rx+b*ux AS dx, fy+a*ry+b*uy AS dy, fz+a*rz+b*uz AS dz FROM px)
SELECT pose_id, row_no, col_no, round(dx/sqrt(dx*dx+dy*dy+dz*dz),9) AS dx, round(dy/sqrt(dx*dx+dy*dy+dz*dz),9) AS dy, round(dz/sqrt(dx*dx+dy*dy+dz*dz),9) AS dz FROM d""")
def _(t):
    k = F.col("s_suppkey")
    poses = t.supplier.select(k.alias("pose_id"), *[v.cast("double").alias(n) for n, v in
                              (("fx", k % 7 - 3), ("fy", -(k % 3) - 1), ("fz", k % 5 + 1))])
    rays = frames.pixel_rays(poses, width=64, height=48, fov_degrees=50.0, cols=(20, 23), rows=(10, 12))
    return rays.select("pose_id", "row_no", "col_no", *[F.round(c, 9).alias(c) for c in ("dx", "dy", "dz")])


@query("b15_shape_features", """SELECT c_custkey AS feature_id, c_nationkey AS geometry, CASE WHEN c_custkey%4=0 THEN NULL ELSE trim(c_name) END AS name, c_custkey%4<>0 AND c_mktsegment<>'MACHINERY' AS interactive,
 CASE WHEN c_custkey%3=0 THEN '#a0b1c2' WHEN c_custkey%3=1 THEN '#cccccc' ELSE '#ABC' END AS color FROM customer""")
def _(t):
    raw = t.customer.select(
        F.col("c_custkey").alias("feature_id"), F.col("c_nationkey").alias("geometry"), F.concat(F.lit(" "), "c_name").alias("name"),
        (F.col("c_custkey") % 4 == 0).alias("hidden"), (F.col("c_mktsegment") == "MACHINERY").alias("background"),
        F.element_at(F.array(F.lit("#a0b1c2"), F.lit("red;"), F.lit("#ABC")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("color"),
    )
    return shaping.shape_features(raw, default_color="#cccccc").drop("hidden", "background")
