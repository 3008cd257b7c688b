"""The registry integrity report over tables derived from the driver tables, with faults of every kind planted."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.operators import registry

N_BUILDINGS = "(SELECT count(*) FROM supplier)"
#: one text per table, the same for both engines
TABLES = {
    "entity": """SELECT entity_id, type, CASE WHEN n%809=7 THEN ' ' ELSE name END AS name, CASE WHEN n%401=17 THEN 'toilet' END AS function,
        CASE WHEN entity_id='floor:7' THEN 'building:none' WHEN entity_id='building:3' THEN 'floor:3' WHEN entity_id='floor:3' THEN 'building:3' ELSE parent_id END AS parent_id,
        CASE WHEN type IN ('space','connector') THEN concat('L', n-CASE WHEN n%611=1 THEN 1 ELSE 0 END+CASE WHEN n%1999=5 THEN 90000000 ELSE 0 END) END AS location_id
        FROM (SELECT e.*, CAST(split_part(entity_id, ':', 2) AS BIGINT) AS n FROM entities e) q""",
    "relation": "SELECT concat('zone:', s_nationkey) AS source_id, concat('building:', (s_suppkey*7+3)%((SELECT count(*) FROM supplier)+2)) AS target_id FROM supplier",
    "rep": """SELECT o_orderkey AS n, concat('rep:', o_orderkey-CASE WHEN o_orderkey%700=9 THEN 1 ELSE 0 END) AS rep_id, concat('space:', o_orderkey+CASE WHEN o_orderkey%1301=4 THEN 90000000 ELSE 0 END) AS entity_id,
        CASE WHEN o_orderkey%1511=8 THEN 'building:1' WHEN o_orderkey%1511=9 THEN 'floor:none' ELSE concat('floor:', o_custkey) END AS floor_id, concat('L', o_orderkey) AS location_id,
        concat('/interiors/', o_custkey, '.json') AS asset, CAST(o_orderkey%100 AS DOUBLE) AS min_x, CAST(o_orderkey%100+CASE WHEN o_orderkey%809=6 THEN -1 ELSE 4 END AS DOUBLE) AS max_x,
        0e0 AS min_y, CASE WHEN o_orderkey%1709=3 THEN CAST('NaN' AS DOUBLE) ELSE 3e0 END AS max_y,
        CAST(o_orderkey%3 AS DOUBLE) AS rep_lo, CAST(o_orderkey%3+CASE WHEN o_orderkey%877=3 THEN 9 ELSE o_orderkey%2 END AS DOUBLE) AS rep_hi FROM orders""",
    "part": """SELECT concat('P', o_orderkey*2+i) AS part_key, concat('L', o_orderkey) AS location_id, NOT (o_orderkey%503=8 AND i=1) AS interactive,
        CAST(o_orderkey%3+i*(o_orderkey%2) AS DOUBLE) AS y, CAST((o_orderkey*2+i)%50 AS DOUBLE) AS x, CAST((o_orderkey*2+i)%70 AS DOUBLE) AS z FROM orders CROSS JOIN range(0,2) q(i)""",
    "rep_part": """SELECT concat('rep:', k) AS rep_id, concat('space:', k) AS entity_id, concat('P', k*2+i+CASE WHEN k%1109=5 THEN 90000000 WHEN k%613=10 AND i=1 THEN 1 ELSE 0 END) AS part_key,
        concat('L', k) AS location_id, CAST(k%3+i*(k%2) AS DOUBLE) AS part_z, CAST(k%3 AS DOUBLE) AS rep_lo, CAST(k%3+CASE WHEN k%877=3 THEN 9 ELSE k%2 END AS DOUBLE) AS rep_hi
        FROM (SELECT o_orderkey AS k FROM orders) o CROSS JOIN range(0,2) q(i) WHERE NOT (k%1201=7 AND i=1)""",
    "stop": """SELECT concat('stop:', o_orderkey) AS stop_id, CASE WHEN o_orderkey%117=9 THEN 'floor:none' WHEN o_orderkey%117=18 THEN 'floor:1' ELSE concat('floor:', o_custkey) END AS floor_id,
        concat('rep:', o_orderkey+CASE WHEN o_orderkey%153=27 THEN 90000000 ELSE 0 END) AS rep_id, concat('P', o_orderkey*2+CASE WHEN o_orderkey%99=36 THEN 2 ELSE 0 END) AS part_key,
        concat('L', o_orderkey+CASE WHEN o_orderkey%171=45 THEN 1 ELSE 0 END) AS location_id, CAST((o_orderkey*2)%50+CASE WHEN o_orderkey%189=54 THEN 1 ELSE 0 END AS DOUBLE) AS x,
        CAST(o_orderkey%3 AS DOUBLE) AS y, CAST((o_orderkey*2)%70 AS DOUBLE) AS z, CASE WHEN o_orderkey%207=63 THEN 'left' END AS door_side FROM orders WHERE o_orderkey%9=0""",
    "legacy": "SELECT concat('campus-', s_suppkey) AS campus_id, concat('building:', s_suppkey+CASE WHEN s_suppkey%37=4 THEN 90000000 ELSE 0 END) AS entity_id FROM supplier WHERE s_suppkey%29<>2",
    "campus": "SELECT concat('campus-', s_suppkey) AS campus_id FROM supplier WHERE s_suppkey%33<>1",
    "asset": "SELECT concat('/interiors/', c_custkey, '.json') AS path FROM customer WHERE c_custkey%97<>5 UNION ALL SELECT concat('/photos/', c_custkey, '.jpg') FROM customer WHERE c_custkey%89<>3",
    "resource": "SELECT concat('res:', c_custkey-CASE WHEN c_custkey%311=10 THEN 1 ELSE 0 END) AS resource_id, concat('/photos/', c_custkey, '.jpg') AS asset FROM customer",
    "binding": f"SELECT concat('res:', c_custkey) AS resource_id, concat('building:', c_custkey%({N_BUILDINGS}+1)) AS entity_id FROM customer",
    "link": "SELECT concat('res:', c_custkey+CASE WHEN c_custkey%409=2 THEN 90000000 ELSE 0 END) AS from_id, concat('res:', CASE WHEN c_custkey%211=1 THEN c_custkey ELSE (c_custkey*7+1)%((SELECT count(*) FROM customer)+3) END) AS to_id FROM customer",
    "street": "SELECT concat('SC', c_custkey) AS street_code, concat('path:', c_custkey) AS entity_id FROM customer WHERE c_custkey%67<>2",
    "segment": """SELECT concat('seg:', line_id*2+seq-CASE WHEN line_id%313=6 THEN seq ELSE 0 END) AS segment_id, concat('SC', line_id) AS street_code, concat('path:', line_id+CASE WHEN line_id%227=9 THEN 1 ELSE 0 END) AS entity_id,
        x1, z1, CASE WHEN line_id%331=7 THEN x1 WHEN line_id%337=8 THEN CAST('NaN' AS DOUBLE) ELSE x2 END AS x2, CASE WHEN line_id%331=7 THEN z1 ELSE z2 END AS z2, show_ground,
        CASE WHEN line_id%59=4 THEN 'Tunnel' ELSE 'Road' END AS street_type, CASE WHEN line_id%251=3 THEN 4e0 END AS deck_height, CASE WHEN line_id%271=5 THEN 3 ELSE 2 END AS declared_lines FROM road_seg""",
    "bundle": f"""SELECT concat('bundle:', s_suppkey) AS bundle_id, concat('building:', s_suppkey+CASE WHEN s_suppkey%41=8 THEN 90000000 WHEN s_suppkey%23=5 THEN 1 ELSE 0 END) AS entity_id, s_suppkey%10=0 AS is_range,
        CASE WHEN s_suppkey%10<>0 AND s_suppkey%17<>6 OR s_suppkey%20=0 THEN CAST(s_suppkey AS VARCHAR(20)) END AS building_id, CAST(s_suppkey%7 AS DOUBLE) AS offset_x, 16+s_suppkey%3 AS width, 16 AS height FROM supplier""",
    "object": f"""SELECT concat('obj:', p_partkey-CASE WHEN p_partkey%509=4 THEN 1 ELSE 0 END) AS object_id, concat('bundle:', p_partkey%({N_BUILDINGS}+CASE WHEN p_partkey%601=3 THEN 90000000 ELSE 0 END)) AS bundle_id,
        CASE WHEN p_partkey%{N_BUILDINGS}%10=0 AND p_partkey%7<>1 THEN 'aggregate-source' ELSE 'building' END AS ownership, CAST(p_partkey%{N_BUILDINGS}%7+CASE WHEN p_partkey%373=1 THEN 1 ELSE 0 END AS DOUBLE) AS offset_x,
        CASE WHEN p_partkey%{N_BUILDINGS}%19=3 THEN 1 ELSE 20 END AS declared_objects FROM part""",
    "mask": """SELECT concat('bundle:', s_suppkey) AS bundle_id, 16+s_suppkey%3+CASE WHEN s_suppkey%31=3 THEN 1 ELSE 0 END AS width, 16 AS height,
        (16+s_suppkey%3)*64 AS bytes FROM supplier WHERE s_suppkey%43<>9""",
}
CTES = ", ".join(f"g_{name} AS ({text})" for name, text in TABLES.items())


def held(table: str, value: str, target: str, column: str, key: str | None = None) -> str:
    return f"SELECT DISTINCT {key or value} AS key FROM g_{table} WHERE ({value}) IS NOT NULL AND ({value}) NOT IN (SELECT {column} FROM g_{target})"


#: every rule as a plain query of its own
RULE_SQL = {
    "dangling-parent": "SELECT entity_id FROM g_entity WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT entity_id FROM g_entity)",
    "duplicate-id": "SELECT entity_id FROM g_entity GROUP BY 1 HAVING count(*)>1",
    "parent-cycle": "SELECT entity_id FROM g_entity WHERE entity_id NOT IN (SELECT entity_id FROM reach)",
    "relation-source_id": "SELECT source_id FROM g_relation WHERE source_id NOT IN (SELECT entity_id FROM g_entity)",
    "relation-target_id": "SELECT target_id FROM g_relation WHERE target_id NOT IN (SELECT entity_id FROM g_entity)",
    "blank-name": "SELECT entity_id FROM g_entity WHERE trim(name)=''",
    "toilet-not-a-space": "SELECT entity_id FROM g_entity WHERE function='toilet' AND type<>'space'",
    "location-of-two-entities": "SELECT location_id FROM g_entity WHERE location_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_id)>1",
    "location-unknown-to-drawings": held("entity", "location_id", "part", "location_id", "entity_id"),
    "legacy-target": held("legacy", "entity_id", "entity", "entity_id", "campus_id"),
    "legacy-without-catalogue": held("legacy", "campus_id", "campus", "campus_id"),
    "catalogue-without-legacy": held("campus", "campus_id", "legacy", "campus_id"),
    "duplicate-representation": "SELECT rep_id FROM g_rep GROUP BY 1 HAVING count(*)>1",
    "representation-owner": held("rep", "entity_id", "entity", "entity_id", "rep_id"),
    "representation-asset": "SELECT DISTINCT rep_id||'' FROM (SELECT rep_id, asset FROM g_rep GROUP BY ALL) WHERE asset NOT IN (SELECT path FROM g_asset)",
    "representation-floor": held("rep", "floor_id", "entity", "entity_id", "rep_id"),
    "bounds": "SELECT rep_id FROM g_rep WHERE isnan(min_x) OR isnan(max_x) OR isnan(min_y) OR isnan(max_y) OR min_x>max_x OR min_y>max_y",
    "representation-floor-type": "SELECT rep_id FROM g_rep r JOIN g_entity e ON e.entity_id=r.floor_id WHERE e.type<>'floor'",
    "part-index": held("rep_part", "part_key", "part", "part_key", "rep_id"),
    "part-of-two-owners": "SELECT part_key FROM g_rep_part GROUP BY 1 HAVING count(DISTINCT entity_id)>1",
    "background-as-room": "SELECT r.part_key FROM g_rep_part r JOIN g_part p ON p.part_key=r.part_key WHERE NOT interactive",
    "part-location": "SELECT r.part_key FROM g_rep_part r JOIN g_part p ON p.part_key=r.part_key WHERE r.location_id<>p.location_id",
    "part-not-covered": "SELECT part_key FROM g_part WHERE interactive AND part_key NOT IN (SELECT part_key FROM g_rep_part)",
    "flattened-room-height": "SELECT rep_id FROM g_rep_part GROUP BY 1 HAVING min(part_z)<>min(rep_lo) OR max(part_z)<>max(rep_hi)",
    "stop-floor": held("stop", "floor_id", "entity", "entity_id", "stop_id"),
    "stop-representation": held("stop", "rep_id", "rep", "rep_id", "stop_id"),
    "stop-floor-differs": "SELECT stop_id FROM g_stop s JOIN g_rep r ON r.rep_id=s.rep_id WHERE s.floor_id<>r.floor_id",
    "stop-part-outside": "SELECT stop_id FROM g_stop s WHERE NOT EXISTS (SELECT 1 FROM g_rep_part p WHERE p.rep_id=s.rep_id AND p.part_key=s.part_key)",
    "stop-location": "SELECT stop_id FROM g_stop s JOIN g_part p ON p.part_key=s.part_key WHERE s.location_id<>p.location_id",
    "stop-position": "SELECT stop_id FROM g_stop s JOIN g_part p ON p.part_key=s.part_key WHERE s.x<>p.x OR s.z<>p.z OR s.y<>p.y",
    "stop-door": "SELECT stop_id FROM g_stop WHERE door_side IS NOT NULL",
    "street-entity": "SELECT segment_id FROM g_segment s JOIN g_street r ON r.street_code=s.street_code WHERE r.entity_id<>s.entity_id",
    "street-code": held("segment", "street_code", "street", "street_code", "segment_id"),
    "line-valid": "SELECT segment_id FROM g_segment WHERE isnan(x1) OR isnan(z1) OR isnan(x2) OR isnan(z2) OR (x1=x2 AND z1=z2)",
    "deck-height": "SELECT segment_id FROM g_segment WHERE deck_height IS NOT NULL",
    "tunnel-on-ground": "SELECT segment_id FROM g_segment WHERE street_type='Tunnel' AND show_ground",
    "segment-twice": "SELECT segment_id FROM g_segment GROUP BY 1 HAVING count(*)>1",
    "street-lines": "SELECT street_code FROM g_segment GROUP BY 1 HAVING count(*)<>max(declared_lines)",
    "bundle-owner": held("bundle", "entity_id", "entity", "entity_id", "bundle_id"),
    "range-with-building": "SELECT bundle_id FROM g_bundle WHERE is_range AND building_id IS NOT NULL",
    "building-without-id": "SELECT bundle_id FROM g_bundle WHERE NOT is_range AND building_id IS NULL",
    "building-id-differs": "SELECT bundle_id FROM g_bundle WHERE NOT is_range AND building_id IS NOT NULL AND 'building:'||building_id<>entity_id",
    "range-ownership": "SELECT object_id FROM g_object o JOIN g_bundle b ON b.bundle_id=o.bundle_id WHERE is_range AND ownership<>'aggregate-source'",
    "object-placed": "SELECT object_id FROM g_object o JOIN g_bundle b ON b.bundle_id=o.bundle_id WHERE o.offset_x<>b.offset_x",
    "object-bundle": held("object", "bundle_id", "bundle", "bundle_id", "object_id"),
    "bundle-objects": "SELECT bundle_id FROM g_object GROUP BY 1 HAVING count(*)<>max(declared_objects)",
    "object-in-two-bundles": "SELECT object_id FROM g_object GROUP BY 1 HAVING count(DISTINCT bundle_id)>1",
    "mask-projection": "SELECT m.bundle_id FROM g_mask m JOIN g_bundle b ON b.bundle_id=m.bundle_id WHERE m.width<>b.width OR m.height<>b.height",
    "mask-bytes": "SELECT bundle_id FROM g_mask WHERE bytes<>width*height*4",
    "bundle-without-mask": held("bundle", "bundle_id", "mask", "bundle_id"),
    "duplicate-resource": "SELECT resource_id FROM g_resource GROUP BY 1 HAVING count(*)>1",
    "resource-asset": "SELECT DISTINCT resource_id||'' FROM (SELECT resource_id, asset FROM g_resource GROUP BY ALL) WHERE asset NOT IN (SELECT path FROM g_asset)",
    "binding-target": held("binding", "entity_id", "entity", "entity_id", "resource_id"),
    "binding-resource": held("binding", "resource_id", "resource", "resource_id"),
    "link-from": held("link", "from_id", "resource", "resource_id"),
    "link-to": held("link", "to_id", "resource", "resource_id"),
    "link-to-itself": "SELECT from_id FROM g_link WHERE from_id=to_id",
}
FOUND = f"""WITH RECURSIVE {CTES}, reach AS (SELECT entity_id FROM g_entity b WHERE NOT EXISTS (SELECT 1 FROM g_entity p WHERE p.entity_id=b.parent_id) UNION SELECT b.entity_id FROM g_entity b JOIN reach r ON b.parent_id=r.entity_id),
found AS ({" UNION ALL ".join(f"SELECT '{name}' AS rule, * FROM ({text}) q(key)" for name, text in RULE_SQL.items())})"""


def tables(t):
    return {name: t.sql(text.replace("VARCHAR(20)", "STRING")) for name, text in TABLES.items()}


@query("k4_registry_report", f"{FOUND} SELECT rule, key FROM found")
def _(t):
    return registry.report(tables(t), registry.rules())


@query("k4_rule_summary", f"""{FOUND}, names AS (SELECT unnest([{", ".join(f"'{n}'" for n in RULE_SQL)}]) AS rule)
SELECT n.rule, count(key) AS violations, min(key) AS first_key FROM names n LEFT JOIN found f ON f.rule=n.rule GROUP BY 1""")
def _(t):
    return registry.summary(registry.report(tables(t), registry.rules()), registry.rules())
