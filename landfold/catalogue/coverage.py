"""Coverage reports: what exists of each building, what picks find, what is to be had, and floors as converted."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.catalogue.audits import cascade_sql, of_kind
from landfold.catalogue.raster import CELLS
from landfold.operators import coverage as cov

# --- sources around domains --------------------------------------------------------


def near_sql(shape: str, guard: str = "10") -> str:
    """nr (poly_id, leaf_id): domains no farther than the guard from a shape's edges (leaf_id, x1, z1, x2, z2).

    The fixture's shapes are smaller than the guard and than any domain, so that a crossing is near a corner, and no domain lies in a shape.
    """
    far = "greatest(0e0,least(1e0,((px-x1)*(x2-x1)+(pz-z1)*(z2-z1))/((x2-x1)*(x2-x1)+(z2-z1)*(z2-z1))))"
    return f"""sb AS (SELECT leaf_id, min(x1) AS x0, max(x1) AS xx, min(z1) AS z0, max(z1) AS zz FROM {shape} GROUP BY 1), pb AS (SELECT poly_id, min(x1) AS x0, max(x1) AS xx, min(z1) AS z0, max(z1) AS zz FROM poly_edge WHERE ring=0 GROUP BY 1),
cc AS (SELECT poly_id, leaf_id FROM pb JOIN sb ON pb.x0-{guard}<=sb.xx AND sb.x0<=pb.xx+{guard} AND pb.z0-{guard}<=sb.zz AND sb.z0<=pb.zz+{guard}),
ends AS (SELECT cc.poly_id, cc.leaf_id, s.x1 AS px, s.z1 AS pz, e.x1, e.z1, e.x2, e.z2, TRUE AS corner FROM cc JOIN poly_edge e ON e.poly_id=cc.poly_id JOIN {shape} s ON s.leaf_id=cc.leaf_id
 UNION ALL SELECT cc.poly_id, cc.leaf_id, e.x1, e.z1, s.x1, s.z1, s.x2, s.z2, FALSE FROM cc JOIN poly_edge e ON e.poly_id=cc.poly_id JOIN {shape} s ON s.leaf_id=cc.leaf_id),
nr AS (SELECT poly_id, leaf_id FROM (SELECT *, {far} AS q FROM ends) f WHERE pow(px-x1-q*(x2-x1),2)+pow(pz-z1-q*(z2-z1),2)<={guard}*{guard}
 UNION SELECT poly_id, leaf_id FROM ends WHERE corner GROUP BY poly_id, leaf_id, px, pz HAVING sum(CASE WHEN ((z1>pz)<>(z2>pz)) AND px<(x2-x1)*(pz-z1)/nullif(z2-z1,0)+x1 THEN 1 ELSE 0 END)%2=1)"""


#: outlines of some buildings, two of which may be one building's, and reference positions of most
OUTLINES = "SELECT poly_id, CASE WHEN poly_id%4<2 THEN concat('building:', poly_id-poly_id%2) ELSE entity_id END AS entity_id, poly_id%2 AS rank, CASE WHEN poly_id%2=0 THEN 'official-drawing' ELSE 'named-polygon' END AS source FROM domains WHERE poly_id%5<>3"
SPOTS = "SELECT entity_id, cx+3 AS x, cz+1 AS z FROM domains WHERE poly_id%10<>8"
LEAVES = "SELECT tri_idx AS leaf_id, least(x1,x2,x3) AS min_x, least(z1,z2,z3) AS min_z, greatest(x1,x2,x3) AS max_x, greatest(z1,z2,z3) AS max_z, tri_idx%7<>2 AS available, tri_idx%3=0 AS downloaded, (tri_idx%5)/2e0 AS error FROM tri"
BUILDINGS = "SELECT entity_id, CASE WHEN poly_id%6=1 THEN concat('bundle:', poly_id) END AS bundle_id FROM domains"
PATCHES = "SELECT DISTINCT mask_id AS patch_id, row_no*2+i AS row_no, col_no*2+j AS col_no FROM mask_cell CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) p CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1) q WHERE r>127"


@query("k8_coverage_report", f"""WITH {CELLS}, ol AS ({OUTLINES}), sp AS ({SPOTS}), lv AS ({LEAVES}), pa AS ({PATCHES}), lone AS (SELECT * FROM sp WHERE entity_id NOT IN (SELECT entity_id FROM ol)),
bx AS (SELECT leaf_id, u.x1, u.z1, u.x2, u.z2 FROM lv, LATERAL (SELECT unnest([struct_pack(x1 := min_x, z1 := min_z, x2 := max_x, z2 := min_z), struct_pack(x1 := max_x, z1 := min_z, x2 := max_x, z2 := max_z), struct_pack(x1 := max_x, z1 := max_z, x2 := min_x, z2 := max_z), struct_pack(x1 := min_x, z1 := max_z, x2 := min_x, z2 := min_z)]) AS u) q),
{near_sql("bx")},
ec AS (SELECT entity_id, row_no, col_no FROM dcell d JOIN ol ON ol.poly_id=d.poly_id UNION SELECT entity_id, CAST(floor(z/4) AS BIGINT), CAST(floor(x/4) AS BIGINT) FROM lone),
mt AS (SELECT entity_id, patch_id, count(*) AS n FROM ec JOIN pa ON pa.row_no=ec.row_no AND pa.col_no=ec.col_no GROUP BY 1,2),
cv AS (SELECT entity_id, count(*) AS samples, count(*) FILTER (EXISTS (SELECT 1 FROM pa WHERE pa.row_no=ec.row_no AND pa.col_no=ec.col_no)) AS covered FROM ec GROUP BY 1),
ar AS (SELECT entity_id, leaf_id FROM nr JOIN ol ON ol.poly_id=nr.poly_id UNION SELECT entity_id, leaf_id FROM lone JOIN lv ON x BETWEEN min_x AND max_x AND z BETWEEN min_z AND max_z),
al AS (SELECT a.entity_id, count(*) FILTER (available) AS leaves, count(*) FILTER (available AND downloaded) AS downloaded, count(*) FILTER (NOT available) AS missing, count(*) FILTER (available AND NOT downloaded) AS open, max(error) FILTER (available) AS max_error FROM ar a JOIN lv ON lv.leaf_id=a.leaf_id GROUP BY 1),
dm AS (SELECT entity_id, arg_min(source, rank) AS source FROM ol GROUP BY 1 UNION ALL SELECT entity_id, 'reference-point-only' FROM lone), bp AS (SELECT entity_id, count(*) AS patches, max(n) AS best FROM mt GROUP BY 1)
SELECT b.entity_id, coalesce(source,'none') AS domain_source, coalesce(samples,0) AS samples, coalesce(patches,0) AS patches, coalesce(covered,0) AS covered, round(best/CAST(samples AS DOUBLE)*100,2) AS best_percent, coalesce(leaves,0) AS leaves, coalesce(downloaded,0) AS downloaded,
 coalesce(missing,0) AS missing, coalesce(open,0) AS open, max_error, CASE WHEN source IS NULL OR source='reference-point-only' THEN 'no-verified-domain' WHEN bundle_id IS NOT NULL THEN 'independent-exterior' WHEN patches>0 THEN 'native-projection' ELSE 'baseline-only' END AS conclusion
FROM ({BUILDINGS}) b LEFT JOIN dm ON dm.entity_id=b.entity_id LEFT JOIN cv ON cv.entity_id=b.entity_id LEFT JOIN bp ON bp.entity_id=b.entity_id LEFT JOIN al ON al.entity_id=b.entity_id""")
def _(t):
    return cov.native_coverage(t.sql(BUILDINGS), t.sql(OUTLINES), t.poly_edge.where("poly_id%5<>3"), t.sql(SPOTS), t.sql(PATCHES), t.sql(LEAVES), 4.0)


#: owners are strips of six faces; some are published whole, some leaves by themselves, some are not in the source
OFFER = "SELECT p_partkey AS leaf_id, CASE WHEN p_partkey%11<>0 THEN p_size END AS bytes FROM part WHERE p_partkey%7<>2"
OUT = "SELECT CAST(floor(p_partkey/6e0) AS BIGINT) AS owner_id, CASE WHEN p_partkey%4=1 THEN p_partkey END AS leaf_id FROM part WHERE p_partkey%4=1 OR floor(p_partkey/6e0)%5=2"
TAKEN = f"""side AS (SELECT tri_idx AS leaf_id, x1, z1, x2, z2 FROM tri UNION ALL SELECT tri_idx, x2, z2, x3, z3 FROM tri UNION ALL SELECT tri_idx, x3, z3, x1, z1 FROM tri), {near_sql("side")}, pu AS ({OUT}), fr AS ({OFFER}),
taken AS (SELECT DISTINCT CAST(floor(n.leaf_id/6e0) AS BIGINT) AS owner_id, n.leaf_id, CASE WHEN poly_id%10<>3 THEN concat('building:', poly_id) END AS entity_id,
 CASE WHEN n.leaf_id IN (SELECT leaf_id FROM pu WHERE leaf_id IS NOT NULL) OR CAST(floor(n.leaf_id/6e0) AS BIGINT) IN (SELECT owner_id FROM pu WHERE leaf_id IS NULL) THEN 'published' WHEN fr.leaf_id IS NULL THEN 'missing' ELSE 'new' END AS state, coalesce(fr.bytes,0) AS bytes FROM nr n LEFT JOIN fr ON fr.leaf_id=n.leaf_id)"""


def taken(t):
    corner = F.inline(F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"z{i}").alias("z")) for i in (1, 2, 3)]))
    owner = F.floor(F.col("tri_idx") / 6).cast("bigint")
    leaves = cov.hull_edges(t.tri.select("tri_idx", corner), "tri_idx", parts=1).withColumn("owner_id", F.floor(F.col("poly_id") / 6).cast("bigint"))
    owners = cov.hull_edges(t.tri.select(owner.alias("owner_id"), corner), "owner_id", parts=1)
    targets = t.poly_edge.withColumn("entity_id", F.when(F.col("poly_id") % 10 != 3, F.concat(F.lit("building:"), "poly_id")))
    return cov.acquisition_leaves(owners, leaves, targets, t.sql(OFFER), t.sql(OUT))


def states_sql(key: str) -> str:
    return f"SELECT {key}, count(*) AS leaves, count(*) FILTER (state='published') AS published_leaves, count(*) FILTER (state='missing') AS missing_leaves, count(*) FILTER (state='new') AS new_leaves, CAST(coalesce(sum(bytes) FILTER (state='new'),0) AS BIGINT) AS new_bytes FROM (SELECT DISTINCT {key}, leaf_id, state, bytes FROM taken WHERE {key} IS NOT NULL) q GROUP BY 1"


@query("k9_acquisition_owners", f"""WITH {TAKEN}, st AS ({states_sql('owner_id')}) SELECT st.*, e.entities, e.corridor FROM st JOIN (SELECT owner_id, count(DISTINCT entity_id) AS entities, bool_or(entity_id IS NULL) AS corridor FROM taken GROUP BY 1) e ON e.owner_id=st.owner_id""")
def _(t):
    return cov.acquisition_owners(taken(t))


@query("k9_acquisition_entities", f"""WITH {TAKEN}, st AS ({states_sql('entity_id')}) SELECT st.*, e.owners, e.planned_owners FROM st JOIN (SELECT entity_id, count(DISTINCT owner_id) AS owners, count(DISTINCT owner_id) FILTER (state='new') AS planned_owners FROM taken GROUP BY 1) e ON e.entity_id=st.entity_id""")
def _(t):
    return cov.acquisition_entities(taken(t))


# --- picks -------------------------------------------------------------------------

#: every third face stands upright
SURFACES = "SELECT CAST(floor(tri_idx/6e0) AS BIGINT) AS object_id, tri_idx, x1, y1, z1, x2, CASE WHEN tri_idx%3=1 THEN y1+z2-z1 ELSE y2 END AS y2, CASE WHEN tri_idx%3=1 THEN z1+y2-y1 ELSE z2 END AS z2, x3, CASE WHEN tri_idx%3=1 THEN y1+z3-z1 ELSE y3 END AS y3, CASE WHEN tri_idx%3=1 THEN z1+y3-y1 ELSE z3 END AS z3 FROM tri"
OBJECTS = """SELECT object_id, layer, bundle_id, entity_id, CASE WHEN object_id%7 IN (3,5) THEN NULL WHEN object_id%5=0 THEN concat('building:', object_id%97) ELSE entity_id END AS owner_id, CASE WHEN object_id%7=5 THEN entity_id END AS range_owner_id, role
 FROM (SELECT DISTINCT CAST(floor(p_partkey/6e0) AS BIGINT) AS object_id, CASE WHEN floor(p_partkey/6e0)%6=5 THEN 'current-form' ELSE 'exterior' END AS layer, concat('bundle:', CAST(floor(p_partkey/6e0) AS BIGINT)%40) AS bundle_id,
  concat('building:', CAST(floor(p_partkey/6e0) AS BIGINT)%(SELECT 1+CAST(floor(count(*)/2e0) AS BIGINT) FROM supplier)) AS entity_id, CASE WHEN floor(p_partkey/6e0)%2=0 THEN 'source-photogrammetry-gap-surface' ELSE 'baseline' END AS role FROM part) q"""
REGISTRY = "SELECT entity_id, type, CASE WHEN entity_id LIKE '%3' THEN 'construction' ELSE 'open' END AS status, CASE WHEN entity_id LIKE '%7' THEN parent_id END AS shared_with FROM entities"
FINDINGS = f"""su AS ({SURFACES}), ob AS ({OBJECTS}), nn AS (SELECT *, (y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) AS nx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) AS ny0, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS nz FROM su),
kd0 AS (SELECT *, abs(ny0/sqrt(nx*nx+ny0*ny0+nz*nz)) AS up FROM nn), kk AS (SELECT *, CASE WHEN up>=72e-2 THEN 'roof' WHEN up<=28e-2 THEN 'facade' END AS side, sqrt(nx*nx+ny0*ny0+nz*nz)/2 AS size FROM kd0),
wt AS (SELECT *, row_number() OVER (PARTITION BY object_id, side ORDER BY size DESC, tri_idx) AS rk FROM kk WHERE side IS NOT NULL),
ow AS (SELECT w.object_id, w.side, w.tri_idx, up, (x1+x2+x3)/3 AS x, (y1+y2+y3)/3 AS y, (z1+z2+z3)/3 AS z, o.*EXCLUDE(object_id, role), o.role AS part_role, CASE WHEN layer='current-form' THEN entity_id ELSE owner_id END AS own FROM wt w JOIN ob o ON o.object_id=w.object_id WHERE rk=1),
pk AS (SELECT struct_pack(o := object_id, k := side) AS pt_id, x, y, z, up AS ny, own AS ex, part_role AS role, object_id AS obj, 0e0 AS ground, FALSE AS kept FROM ow), {cascade_sql("pk")},
fi AS (SELECT o.object_id, o.layer, o.entity_id, o.side AS kind, o.tri_idx, coalesce(own, range_owner_id) AS expected_id, t.entity_id AS picked_id, method, part_role FROM ow o JOIN told t ON t.pt_id.o=o.object_id AND t.pt_id.k=o.side),
fd AS (SELECT * EXCLUDE(part_role), CASE WHEN layer='current-form' THEN CASE WHEN picked_id=expected_id THEN 'pass-static-owner' ELSE 'fail' END WHEN expected_id IS NOT NULL THEN CASE WHEN picked_id=expected_id THEN 'pass' WHEN picked_id IS NOT NULL THEN 'misassigned' ELSE 'missed-owner' END
 WHEN picked_id IS NOT NULL THEN CASE WHEN part_role='source-photogrammetry-gap-surface' THEN 'unowned-supplement-fallback' ELSE 'misassigned' END ELSE 'unassigned-visible-surface' END AS status FROM fi)"""


def findings(t):
    return cov.pick_findings(t.sql(SURFACES), t.sql(OBJECTS), F.lit(0.0), t.poly_edge, of_kind(t), t.road_seg, 0.4)


@query("k15_pick_findings", f"WITH {FINDINGS} SELECT * FROM fd")
def _(t):
    return findings(t)


@query("k15_pick_report", f"""WITH {FINDINGS}, rg0 AS ({REGISTRY}), sn AS (SELECT entity_id, kind, status FROM fd UNION ALL SELECT picked_id, kind, status FROM fd WHERE layer='exterior' AND picked_id IS NOT NULL AND picked_id IS DISTINCT FROM entity_id),
se AS (SELECT entity_id, count(*) AS findings, bool_or(kind='roof' AND status IN ('pass','pass-static-owner')) AS roof, bool_or(kind='facade' AND status IN ('pass','pass-static-owner')) AS facade FROM sn GROUP BY 1),
hl AS (SELECT entity_id, count(DISTINCT bundle_id) FILTER (layer='exterior') AS bundles, count(DISTINCT bundle_id) FILTER (layer='current-form') AS current_forms FROM ob GROUP BY 1), dn AS (SELECT entity_id, count(*) AS domains FROM kd GROUP BY 1),
al AS (SELECT entity_id FROM rg0 WHERE type='building' UNION SELECT entity_id FROM se UNION SELECT entity_id FROM hl UNION SELECT entity_id FROM dn),
j AS (SELECT a.entity_id, coalesce(findings,0) AS findings, coalesce(bundles,0) AS bundles, coalesce(current_forms,0) AS current_forms, coalesce(domains,0) AS domains, coalesce(roof,FALSE) AS roof, coalesce(facade,FALSE) AS facade, r.status AS life, shared_with
 FROM al a LEFT JOIN se ON se.entity_id=a.entity_id LEFT JOIN hl ON hl.entity_id=a.entity_id LEFT JOIN dn ON dn.entity_id=a.entity_id LEFT JOIN rg0 r ON r.entity_id=a.entity_id),
c2 AS (SELECT *, CASE WHEN roof AND facade THEN 'direct-roof-and-facade-ray-proven' WHEN roof OR facade THEN 'partial-one-surface-ray' WHEN current_forms>0 THEN 'current-form-manifest-only' WHEN bundles>0 THEN 'no-independent-hit' ELSE 'list-or-registry-only' END AS coverage FROM j)
SELECT entity_id, coverage, CASE WHEN coverage<>'list-or-registry-only' THEN 'direct-visible-scope' WHEN life='construction' THEN 'construction-or-upcoming-record' WHEN shared_with IS NOT NULL THEN 'named-member-of-shared-physical-domain' ELSE 'current-service-name-without-independent-domain' END AS scope_role,
 findings, bundles, current_forms, domains, concat_ws(',', CASE WHEN bundles=0 THEN 'no-exterior-bundle' END, CASE WHEN current_forms=0 THEN 'no-current-form' END, CASE WHEN domains>1 THEN 'multiple-domains-or-shared-scope' END, CASE WHEN coverage='no-independent-hit' THEN 'missing-visible-geometry-or-owner' END) AS flags FROM c2""")
def _(t):
    d = of_kind(t)
    found = findings(t)
    return cov.pick_coverage(t.sql(REGISTRY), t.sql(OBJECTS), found, d).withColumn("flags", F.array_join("flags", ","))


# --- triage ------------------------------------------------------------------------

SIZES = "SELECT entity_id, CASE WHEN poly_id%9<>4 THEN r*r*25e-1 END AS area, poly_id%5=0 AS focus FROM domains"
LINKS = "SELECT concat('building:', o_custkey%(SELECT count(*) FROM supplier)) AS entity_id, o_orderkey%(SELECT count(*) FROM part) AS owner_id FROM orders WHERE o_orderkey%3<>1"
LEVELS = """SELECT p_partkey AS owner_id, 'high' AS level, CAST(p_size*10 AS BIGINT) AS triangles, CAST(p_size*100 AS BIGINT) AS texture_bytes FROM part WHERE p_partkey%13<>5
 UNION ALL SELECT p_partkey, 'fine', CAST(p_size*(10+p_partkey%4) AS BIGINT), CAST(p_size*(80+p_partkey%60) AS BIGINT) FROM part WHERE p_partkey%13<>5 AND p_partkey%4<>1"""
PIXELS = "SELECT p_partkey AS owner_id, 'high' AS level, p_partkey%37 AS row_no, p_partkey%29 AS col_no FROM part UNION ALL SELECT p_partkey, 'fine', p_partkey%37+5, p_partkey%31 FROM part WHERE p_partkey%4<>1 UNION ALL SELECT p_partkey, 'fine', p_partkey%37+6, p_partkey%31 FROM part WHERE p_partkey%4=2"
EXTERIORS = "SELECT concat('building:', p_partkey%(SELECT count(*) FROM supplier)) AS entity_id, CAST(p_size*7 AS BIGINT) AS triangles FROM part WHERE p_partkey%6=1"
FORMS = "SELECT concat('building:', c_custkey) AS entity_id, CASE WHEN c_custkey%3=0 THEN 'current-form-space' ELSE 'building' END AS kind, CASE c_custkey%5 WHEN 1 THEN 'installed-set' WHEN 2 THEN 'draft' END AS status, CASE WHEN c_custkey%7=1 THEN 'Review Pending' END AS adoption FROM customer WHERE c_custkey%4=1"


@query("k16_triage_report", f"""WITH li AS (SELECT DISTINCT * FROM ({LINKS}) q), le AS ({LEVELS}), px AS ({PIXELS}), ex AS ({EXTERIORS}), fm AS ({FORMS}),
cn AS (SELECT entity_id, count(*) AS owners, count(*) FILTER (owner_id NOT IN (SELECT owner_id FROM le)) AS missing_owners FROM li GROUP BY 1),
sm AS (SELECT entity_id, sum(triangles) FILTER (level='high') AS ht, sum(triangles) FILTER (level='fine') AS ft, sum(texture_bytes) FILTER (level='high') AS hx, sum(texture_bytes) FILTER (level='fine') AS fx FROM li JOIN le ON le.owner_id=li.owner_id GROUP BY 1),
ua AS (SELECT entity_id, count(*) FILTER (level='high')*25e-2 AS ha, count(*) FILTER (level='fine')*25e-2 AS fa FROM (SELECT DISTINCT entity_id, level, row_no, col_no FROM li JOIN px ON px.owner_id=li.owner_id) q GROUP BY 1),
j AS (SELECT s.entity_id, area, focus, coalesce(owners,0) AS owners, coalesce(missing_owners,0) AS missing_owners, CAST(coalesce(ht,0) AS BIGINT) AS high_triangles, CAST(coalesce(ft,0) AS BIGINT) AS fine_triangles, CAST(coalesce(hx,0) AS BIGINT) AS high_texture_bytes, CAST(coalesce(fx,0) AS BIGINT) AS fine_texture_bytes,
 (SELECT count(*) FROM ex WHERE ex.entity_id=s.entity_id) AS exteriors, CAST(coalesce((SELECT sum(triangles) FROM ex WHERE ex.entity_id=s.entity_id),0) AS BIGINT) AS exterior_triangles, (SELECT count(*) FROM fm WHERE fm.entity_id=s.entity_id) AS forms, coalesce(ha,0e0) AS high_area, coalesce(fa,0e0) AS fine_area,
 EXISTS (SELECT 1 FROM fm WHERE fm.entity_id=s.entity_id AND (kind='current-form-space' OR status<>'installed-set' OR contains(lower(adoption),'pending'))) AS needs_review FROM ({SIZES}) s LEFT JOIN cn ON cn.entity_id=s.entity_id LEFT JOIN sm ON sm.entity_id=s.entity_id LEFT JOIN ua ON ua.entity_id=s.entity_id),
k AS (SELECT * EXCLUDE(area), round(fine_triangles/nullif(CAST(high_triangles AS DOUBLE),0),4) AS triangle_ratio, round(fine_texture_bytes/nullif(CAST(high_texture_bytes AS DOUBLE),0),4) AS texture_ratio, round(fine_area/nullif(area,0),4) AS inflation, round((fine_area-high_area)/nullif(high_area,0)*100,2) AS area_gain FROM j),
sc AS (SELECT *, CAST(CASE WHEN forms>0 THEN 5 ELSE 0 END+CASE WHEN needs_review THEN 2 ELSE 0 END+CASE WHEN focus THEN 3 ELSE 0 END+CASE WHEN missing_owners>0 THEN 2 ELSE 0 END+CASE WHEN texture_ratio<11e-1 THEN 2 ELSE 0 END+CASE WHEN triangle_ratio<11e-1 THEN 1 ELSE 0 END AS INTEGER) AS score FROM k)
SELECT * EXCLUDE(focus), CASE WHEN score>=8 THEN 'P0' WHEN score>=5 THEN 'P1' WHEN score>=3 THEN 'P2' ELSE 'P3' END AS level,
 concat_ws(',',CASE WHEN forms>0 THEN 'current-form' END,CASE WHEN needs_review THEN 'runtime-review' END,CASE WHEN focus THEN 'focus' END,CASE WHEN missing_owners>0 THEN 'missing-owners' END,CASE WHEN texture_ratio<11e-1 THEN 'texture-gain' END,CASE WHEN triangle_ratio<11e-1 THEN 'geometry-gain' END) AS reasons FROM sc""")
def _(t):
    out = cov.quality_triage(t.sql(SIZES), t.sql(LINKS), t.sql(LEVELS), t.sql(PIXELS), t.sql(EXTERIORS), t.sql(FORMS), 0.5)
    return out.withColumn("reasons", F.array_join("reasons", ","))


# --- floors ------------------------------------------------------------------------

FLOORS = "SELECT c_custkey AS floor_id, c_custkey%9<>4 AS shown FROM customer"
FEATURES = "SELECT o_custkey AS floor_id, o_orderkey AS feature_id, CASE o_orderkey%8 WHEN 7 THEN NULL WHEN 0 THEN TRUE ELSE FALSE END AS hidden, CASE WHEN o_orderkey%6=1 THEN ' ' WHEN o_orderkey%6<>2 THEN concat('R', o_orderkey) END AS name FROM orders"
#: a square per part, from its lowest corner round to it; some rings do not close, some parts are not level
CORNERS = """SELECT feature_id, part, 0 AS ring, seq, (feature_id%50)*4+part*2+CASE WHEN seq IN (1,2) THEN 1e0 ELSE 0e0 END+CASE WHEN seq=4 AND feature_id%97=5 THEN 25e-2 ELSE 0e0 END AS x, (feature_id%3)*15e-1+CASE WHEN seq=2 AND feature_id%89=3 THEN 25e-2 ELSE 0e0 END AS y,
 (feature_id%40)*3+CASE WHEN seq IN (2,3) THEN 1e0 ELSE 0e0 END AS z FROM (SELECT o_orderkey AS feature_id, p.part, s.seq FROM orders CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1) p CROSS JOIN (SELECT 0 AS seq UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) s WHERE o_orderkey%10<>7 AND (p.part=0 OR o_orderkey%5=0)) v"""
LINES = "SELECT o_custkey AS floor_id, (o_orderkey%5)/1e0 AS x1, 0e0 AS z1, (o_orderkey%7)/1e0 AS x2, (o_orderkey%2)/5e3 AS z2 FROM orders WHERE o_orderkey%4=1 UNION ALL SELECT o_custkey, (o_orderkey%7)/1e0, 0e0, (o_orderkey%5)/1e0, 0e0 FROM orders WHERE o_orderkey%4=1"
FLOOR_SQL = f"""f AS (SELECT q.floor_id, feature_id, coalesce(hidden,TRUE) AS hidden, name FROM ({FEATURES}) q JOIN ({FLOORS}) l ON l.floor_id=q.floor_id WHERE shown), v AS ({CORNERS}),
pt AS (SELECT floor_id, f.feature_id, part, min(y) AS lo, max(y) AS hi, min(x) AS x0, max(x) AS x9, min(z) AS z0, max(z) AS z9, CASE WHEN max(x) FILTER (seq=0)<>max(x) FILTER (seq=4) THEN 1 ELSE 0 END AS bad FROM f JOIN v ON v.feature_id=f.feature_id GROUP BY 1,2,3),
st AS (SELECT floor_id, count(*) AS features, count(*) FILTER (there AND NOT hidden) AS labelled, count(*) FILTER (there AND NOT hidden AND trim(coalesce(name,''))<>'') AS named, count(*) FILTER (there AND hidden) AS background, count(*) FILTER (NOT there) AS unsupported FROM (SELECT f.*, feature_id IN (SELECT feature_id FROM pt) AS there FROM f) q GROUP BY 1),
bo AS (SELECT floor_id, count(*) AS parts, CAST(sum(bad) AS BIGINT) AS open_rings, count(*) FILTER (lo<>hi) AS uneven_parts, min(x0) AS min_x, max(x9) AS max_x, min(z0) AS min_z, max(z9) AS max_z FROM pt GROUP BY 1),
hh AS (SELECT floor_id, count(*) AS heights, CASE WHEN count(*)=1 THEN min(lo) END AS z, arg_min(lo, (-n, lo)) AS modal_z FROM (SELECT floor_id, lo, count(*) AS n FROM pt GROUP BY 1,2) q GROUP BY 1),
cd AS (SELECT floor_id, count(*) AS segments FROM (SELECT DISTINCT floor_id, CASE WHEN (a,b)<=(c,d) THEN [a,b,c,d] ELSE [c,d,a,b] END AS s FROM (SELECT floor_id, x1 AS a, round(z1,3) AS b, x2 AS c, round(z2,3) AS d FROM ({LINES}) l) r WHERE a<>c OR b<>d) q GROUP BY 1),
stats AS (SELECT l.floor_id, coalesce(features,0) AS features, coalesce(labelled,0) AS labelled, coalesce(named,0) AS named, coalesce(background,0) AS background, coalesce(unsupported,0) AS unsupported, coalesce(parts,0) AS parts, coalesce(heights,0) AS heights, coalesce(segments,0) AS segments, coalesce(open_rings,0) AS open_rings, coalesce(uneven_parts,0) AS uneven_parts, z, modal_z, min_x, max_x, min_z, max_z
 FROM ({FLOORS}) l LEFT JOIN st ON st.floor_id=l.floor_id LEFT JOIN bo ON bo.floor_id=l.floor_id LEFT JOIN hh ON hh.floor_id=l.floor_id LEFT JOIN cd ON cd.floor_id=l.floor_id WHERE shown)"""


def floors(t):
    return cov.floor_statistics(t.sql(FLOORS), t.sql(FEATURES), t.sql(CORNERS), t.sql(LINES))


@query("k21_floor_report", f"WITH {FLOOR_SQL} SELECT * FROM stats")
def _(t):
    return floors(t)


@query("k21_floor_totals", f"""WITH {FLOOR_SQL} SELECT count(*) AS floors, {', '.join(f'CAST(coalesce(sum({c}),0) AS BIGINT) AS {c}' for c in ('features', 'labelled', 'named', 'background', 'unsupported', 'parts', 'segments'))},
 count(*) FILTER (labelled=0) AS without_labelled, count(*) FILTER (segments>0) AS with_lines, count(*) FILTER (heights>1) AS with_several_heights FROM stats""")
def _(t):
    return cov.floor_totals(floors(t))
