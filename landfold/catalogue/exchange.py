"""Tables written to the shared folder in the exchange formats and scanned back, and release jobs."""

import uuid

from pyspark.sql import functions as F

from landfold.catalogue import mesh as meshq, query
from landfold.catalogue.hierarchy import STAGED, strict_sql
from landfold.catalogue.predicates import OCC, sight
from landfold.catalogue.scalars import NORMAL
from landfold.functions import geometry as g
from landfold.operators import audits, frames, hierarchy as h, linkage as l, mesh as m, occlusion, polygons, raster as r, selection as sel, shaping
from landfold.session import checkpoint_dir
from landfold.sources import releases, scans


def scratch(t, name):
    return f"{checkpoint_dir(t.spark).rstrip('/')}/landfold-{name}-{uuid.uuid4().hex}"


@query("a1_manifest_scan", "SELECT CAST(o_custkey AS BIGINT) AS id, 'tile/'||o_orderkey||'/'||i AS url, o_orderkey+i AS bytes FROM orders, range(0,2) q(i)")
def _(t):
    tile = lambda i: F.struct(F.concat(F.lit("tile/"), "o_orderkey", F.lit(f"/{i}")).alias("url"), (F.col("o_orderkey") + i).alias("bytes"))
    path = scratch(t, "manifest")
    t.orders.select(F.col("o_custkey").alias("id"), F.array(tile(0), tile(1)).alias("tiles")).write.json(path)
    return scans.read_manifest(t.spark, path, "id long, tiles array<struct<url: string, bytes: long>>", "tiles", multi_line=False)


@query("a2_registry_scan", "SELECT type, count(*) AS n, count(parent_id) AS with_parent FROM entities GROUP BY 1")
def _(t):
    path = scratch(t, "registry")
    t.entities.write.json(path)
    return scans.read_registry(t.spark, path).groupBy("type").agg(F.count("*").alias("n"), F.count("parent_id").alias("with_parent"))


#: rings of the features: the outline, a hole in every third, and a second part with a hole in every fifth, which makes it a MultiPolygon
RINGS = {(0, 0): 1.0, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.125}
LOOP = [(1, 0), (.75, .75), (0, 1), (-.75, .75), (-1, 0), (-.75, -.75), (0, -1), (.75, -.75), (1, 0)]


@query("a3_geojson_scan", """WITH p AS (SELECT * FROM domains, (VALUES (0,0,1e0),(0,1,25e-2),(1,0,5e-1),(1,1,125e-3)) v(part,ring,k) WHERE (part=0 OR poly_id%5=0) AND (ring=0 OR poly_id%3=0)),
 x AS (SELECT *, cx+part*200+dx*k*r AS x, cz+dz*k*r AS y FROM p, (VALUES (0,1e0,0e0),(1,75e-2,75e-2),(2,0e0,1e0),(3,-75e-2,75e-2),(4,-1e0,0e0),(5,-75e-2,-75e-2),(6,0e0,-1e0),(7,75e-2,-75e-2),(8,1e0,0e0)) l(seq,dx,dz))
SELECT poly_id, CASE WHEN poly_id%5=0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, CAST(seq AS INTEGER) AS seq, x, y FROM x""")
def _(t):
    path = scratch(t, "features")

    def ring(part, k):
        at = lambda dx, dz: F.concat(F.lit("["), (F.col("cx") + 200 * part + dx * k * F.col("r")).cast("string"), F.lit(","), (F.col("cz") + dz * k * F.col("r")).cast("string"), F.lit("]"))
        return F.concat(F.lit("["), F.concat_ws(",", *[at(a, b) for a, b in LOOP]), F.lit("]"))

    part = {n: F.concat(F.lit("["), F.concat_ws(",", ring(n, RINGS[n, 0]), F.when(F.col("poly_id") % 3 == 0, ring(n, RINGS[n, 1]))), F.lit("]")) for n in (0, 1)}
    many = F.col("poly_id") % 5 == 0
    shape = F.when(many, F.concat(F.lit('"MultiPolygon","coordinates":['), part[0], F.lit(","), part[1], F.lit("]"))).otherwise(F.concat(F.lit('"Polygon","coordinates":'), part[0]))
    doc = F.concat(F.lit('{"crs":{"properties":{"name":"EPSG:2326"}},"features":[{"properties":{"id":"'), "poly_id", F.lit('"},"geometry":{"type":'), shape, F.lit("}}]}"))
    t.domains.select(doc.alias("value")).write.text(path)
    f = scans.read_geojson(t.spark, path, "EPSG:2326", multi_line=False)
    return f.select(F.col("properties")["id"].cast("bigint").alias("poly_id"), "kind", "part", "ring", "seq", "x", "y")


@query("a4_gml_scan", "SELECT line_id*2+seq AS id, CAST(v AS INTEGER) AS seq, CASE WHEN v=0 THEN x1 ELSE x2 END AS x, CASE WHEN v=0 THEN z1 ELSE z2 END AS y FROM road_seg, range(0,2) q(v)")
def _(t):
    path = scratch(t, "members")
    p = lambda i: F.concat_ws(" ", f"z{i}", f"x{i}", F.lit("0"))
    t.road_seg.select(F.concat(F.lit("<member><id>"), F.col("line_id") * 2 + F.col("seq"), F.lit("</id><posList>"), F.concat_ws(" ", p(1), p(1), p(2)), F.lit("</posList></member>")).alias("value")).write.text(path)
    return scans.read_gml(t.spark, path, "member", "id long, posList string", multi_line=False).select("id", "seq", "x", "y")


@query("a9_write_manifest", """WITH r AS (SELECT bytes, CAST('0x'||substr(sha256('{"bytes":'||bytes||',"path":"'||path||'","sha256":"'||sha256||'"}'), 1, 15) AS BIGINT) AS part FROM inv_a)
SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(CAST(sum(CAST(part AS HUGEINT)) AS VARCHAR)) AS digest FROM r""")
def _(t):
    return releases.write_manifest(t.inv_a, scratch(t, "summary"))


@query("a10_publish", "SELECT path, bytes, sha256 FROM inv_a")
def _(t):
    root = scratch(t, "release")
    releases.publish(t.inv_a, root)
    return releases.read_release(t.spark, root)


#: the corners and the middle of each face, and what the masks say there
PROBES = "pb AS (SELECT tri_idx, u.x, u.y, u.z, ny/sqrt(nx*nx+ny*ny+nz*nz) AS up FROM n, LATERAL (SELECT unnest([struct_pack(x := x1, y := y1, z := z1), struct_pack(x := x2, y := y2, z := z2), struct_pack(x := x3, y := y3, z := z3), struct_pack(x := (x1+x2+x3)/3, y := (y1+y2+y3)/3, z := (z1+z2+z3)/3)]) AS u) q)"


@query("k6_remnant_audit", f"""WITH {meshq.comp_sql('tile')}, {NORMAL}, {PROBES}, sm AS (SELECT p.*, m.* FROM pb p JOIN mask_cell m ON m.row_no=CAST(floor(z/8e0) AS BIGINT) AND m.col_no=CAST(floor(x/8e0) AS BIGINT)),
held AS (SELECT DISTINCT tri_idx FROM sm WHERE r>127 AND y>=CASE WHEN a=255 THEN 0e0 ELSE greatest(0e0,CAST(a AS DOUBLE)) END AND y<=60), kept AS (SELECT DISTINCT tri_idx FROM sm WHERE r>127 AND abs(y-g-b/256e0)<=125e-2 AND abs(up)>=6e-1)
SELECT c.component, count(*) AS faces, round(sum(sqrt(nx*nx+ny*ny+nz*nz)/2),6) AS area FROM comp c JOIN n ON n.tri_idx=c.tri_idx WHERE c.tri_idx%13<>4 AND c.tri_idx NOT IN (SELECT tri_idx FROM held) AND c.tri_idx NOT IN (SELECT tri_idx FROM kept) GROUP BY 1""")
def _(t):
    comp = m.components(t.tri, scope=["tile_id"])
    left = m.apply_corrections(t.tri, t.tri.where("tri_idx%13=4"))
    return audits.remnants(left, comp, t.mask_cell, 8.0, cap=60.0)


@query("k7_viewport_audit", f"WITH {meshq.RAYS}, {meshq.comp_sql()}, b AS (SELECT ray_id, min(dist) AS block FROM hit WHERE tri_idx%4=1 GROUP BY 1), v AS (SELECT h.ray_id, h.tri_idx, row_number() OVER (PARTITION BY h.ray_id ORDER BY h.dist, h.tri_idx) AS rn FROM hit h LEFT JOIN b ON b.ray_id=h.ray_id WHERE h.tri_idx%4<>1 AND (block IS NULL OR dist<block)) SELECT c.component, count(*) AS hits, count(DISTINCT v.tri_idx) AS faces FROM v JOIN comp c ON c.tri_idx=v.tri_idx WHERE rn=1 GROUP BY 1")
def _(t):
    hits = meshq.hits(t)
    seen = m.first_hit(m.before_blocker(hits.where("tri_idx%4<>1"), hits.where("tri_idx%4=1")))
    return m.hit_histogram(seen, m.components(t.tri))


@query("k9_acquisition_plan", """WITH tb AS (SELECT tri_idx AS tile_id, least(x1,x2,x3) AS x0, greatest(x1,x2,x3) AS xx, least(z1,z2,z3) AS z0, greatest(z1,z2,z3) AS zz FROM tri), need AS (SELECT poly_id, tile_id FROM domains d JOIN tb ON cx-r-10<=xx AND x0<=cx+r+10 AND cz-r-10<=zz AND z0<=cz+r+10)
SELECT poly_id, count(*) AS tiles, count(CASE WHEN tile_id%3=0 THEN 1 END) AS published, CAST(sum(CASE WHEN tile_id%3<>0 THEN p_size ELSE 0 END) AS BIGINT) AS new_bytes FROM need JOIN part ON p_partkey=tile_id GROUP BY 1""")
def _(t):
    dom = t.domains.select("poly_id", *[(F.col(c) + s * F.col("r")).alias(n) for n, c, s in (("min_x", "cx", -1), ("min_z", "cz", -1), ("max_x", "cx", 1), ("max_z", "cz", 1))])
    tiles = t.tri.select(F.col("tri_idx").alias("tile_id"), *[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"{n}_{a}") for n, f in (("min", F.least), ("max", F.greatest)) for a in "xz"])
    need = sel.tiles_for_domains(dom, tiles, 10.0).join(t.part.select(F.col("p_partkey").alias("tile_id"), "p_size"), "tile_id")
    have = F.col("tile_id") % 3 == 0
    return need.groupBy("poly_id").agg(F.count("*").alias("tiles"), F.count(F.when(have, 1)).alias("published"), F.sum(F.when(~have, F.col("p_size")).otherwise(0)).alias("new_bytes"))


#: what was staged: leaves by their number, some left out, some not of the frontier, one in a few twice
LANDED = "SELECT node_id FROM lod_node WHERE node_id%4<>0 AND node_id%53<>6 UNION ALL SELECT node_id FROM lod_node WHERE node_id%211=9"
PLANNED = "SELECT CAST(floor((o_orderkey-1)/16e0) AS BIGINT) AS owner_id, count(*)+max(CASE WHEN o_orderkey%640=1 THEN 1 ELSE 0 END) AS leaves FROM orders WHERE o_orderkey BETWEEN 337 AND 1360 GROUP BY 1"


@query("k10_stage_check", f"""WITH RECURSIVE {strict_sql(STAGED, "FALSE", "error<>0", 3)}, landed AS ({LANDED}), planned AS ({PLANNED}),
 ow AS (SELECT owner_id, count(*) AS nodes FROM fr WHERE owner_id IS NOT NULL GROUP BY 1)
SELECT 'frontier-'||reason AS rule, CAST(node_id AS VARCHAR) AS key FROM fr WHERE reason IS NOT NULL
UNION ALL SELECT 'leaf-not-staged', CAST(node_id AS VARCHAR) FROM fr WHERE node_id NOT IN (SELECT node_id FROM landed)
UNION ALL SELECT DISTINCT 'staged-outside-frontier', CAST(node_id AS VARCHAR) FROM landed WHERE node_id NOT IN (SELECT node_id FROM fr)
UNION ALL SELECT 'staged-twice', CAST(node_id AS VARCHAR) FROM landed GROUP BY node_id HAVING count(*)>1
UNION ALL SELECT 'owner-leaf-count', CAST(coalesce(p.owner_id, o.owner_id) AS VARCHAR) FROM planned p FULL JOIN ow o ON o.owner_id=p.owner_id WHERE leaves IS DISTINCT FROM nodes
UNION ALL SELECT 'hash-differs', a.path FROM inv_a a JOIN inv_b b ON b.path=a.path WHERE a.sha256<>b.sha256""")
def _(t):
    found = h.stage_violations(t.sql(STAGED), t.sql(LANDED), t.sql(PLANNED), 3)
    diff = l.inventory_diff(t.inv_a, t.inv_b, "path", ["sha256"]).where("change='changed'")
    return found.select("rule", F.col("key").cast("string").alias("key")).unionByName(diff.select(F.lit("hash-differs").alias("rule"), F.col("path").alias("key")))


@query("k15_pick_coverage", f"""WITH {NORMAL}, w AS (SELECT tri_idx%(SELECT count(*) FROM supplier) AS building, abs(ny/sqrt(nx*nx+ny*ny+nz*nz)) AS a, tri_idx FROM n), p AS (SELECT building, bool_or(a>=72e-2 AND tri_idx%3=0) AS roof, bool_or(a<=28e-2 AND tri_idx%3=0) AS facade FROM w GROUP BY 1)
SELECT s_suppkey AS building, CASE WHEN roof AND facade THEN 'direct-roof-and-facade-ray-proven' WHEN roof OR facade THEN 'partial' ELSE 'list-or-registry-only' END AS coverage FROM supplier LEFT JOIN p ON p.building=s_suppkey""")
def _(t):
    n = t.supplier.count()
    proof = t.tri.withColumns({"building": F.col("tri_idx") % n, "slope": g.slope_class(g.normalise(g.face_normal())[1], roof=0.72, wall=0.28)}).where("tri_idx%3=0")
    p = proof.groupBy("building").agg(F.bool_or(F.col("slope") == "roof").alias("roof"), F.bool_or(F.col("slope") == "wall").alias("facade"))
    j = t.supplier.select(F.col("s_suppkey").alias("building")).join(p, "building", "left").fillna(False, ["roof", "facade"])
    return j.select("building", F.when(F.col("roof") & F.col("facade"), "direct-roof-and-facade-ray-proven").when(F.col("roof") | F.col("facade"), "partial").otherwise("list-or-registry-only").alias("coverage"))


@query("k21_floor_statistics", """SELECT o_custkey AS floor_id, count(*) AS features, count(CASE WHEN o_orderkey%4<>0 THEN 1 END) AS named, count(CASE WHEN o_orderkey%4=0 THEN 1 END) AS hidden, count(DISTINCT o_orderkey%3) AS levels FROM orders GROUP BY 1""")
def _(t):
    raw = t.orders.select(F.col("o_custkey").alias("floor_id"), F.concat(F.lit("R"), "o_orderkey").alias("name"), (F.col("o_orderkey") % 4 == 0).alias("hidden"), F.lit(False).alias("background"),
                          F.lit("#fff").alias("color"), (F.col("o_orderkey") % 3).alias("z"))
    f = shaping.shape_features(raw)
    # Distinct levels per floor by two plain groupings, not a distinct set per floor.
    per = f.groupBy("floor_id", "z").agg(F.count("*").alias("n"), F.count("name").alias("named"), F.count(F.when(F.col("hidden"), 1)).alias("hidden"))
    return per.groupBy("floor_id").agg(F.sum("n").alias("features"), F.sum("named").alias("named"), F.sum("hidden").alias("hidden"), F.count("*").alias("levels"))
