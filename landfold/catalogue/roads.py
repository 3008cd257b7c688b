"""Road lines in views, and corridors under a budget."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.catalogue.raster import STEP, dem_rows, dem_sql
from landfold.functions.geometry import basis
from landfold.operators import roads, selection as sel
from landfold.session import cut_lineage

#: a view above every domain, looking down and in one of eight directions
POSE = "SELECT poly_id AS pose_id, cx AS ex, CAST(30+poly_id%3*10 AS DOUBLE) AS ey, cz AS ez, CAST(poly_id%3-1 AS DOUBLE) AS fx, -4e-1 AS fy, CASE WHEN poly_id%2=0 THEN 1e0 ELSE -1e0 END AS fz FROM domains"
HEIGHT, ASPECT, FOV, NEAR, FAR = 900.0, 1.6, 50.0, 0.5, 220.0


def clip(p: str) -> str:
    """The four clip coordinates of point p in view v."""
    d = [f"({p}.{a}-v.e{a})" for a in "xyz"]
    dot = lambda b: "(" + "+".join(f"{d[i]}*v.{b}{a}" for i, a in enumerate("xyz")) + ")"
    return f"struct_pack(x := {dot('r')}/(tan(radians({FOV / 2}::DOUBLE))*{ASPECT}::DOUBLE), y := {dot('u')}/tan(radians({FOV / 2}::DOUBLE)), z := ({dot('f')}*{FAR + NEAR}::DOUBLE-{2 * FAR * NEAR}::DOUBLE)/{FAR - NEAR}::DOUBLE, w := {dot('f')})"


SEEN = f"""vf AS (SELECT pose_id, ex, ey, ez, fx/sqrt(fx*fx+fy*fy+fz*fz) AS fx, fy/sqrt(fx*fx+fy*fy+fz*fz) AS fy, fz/sqrt(fx*fx+fy*fy+fz*fz) AS fz FROM ({POSE}) p),
vr AS (SELECT *, -fz/sqrt(fz*fz+fx*fx) AS rx, 0e0 AS ry, fx/sqrt(fz*fz+fx*fx) AS rz FROM vf), vw AS (SELECT *, ry*fz-rz*fy AS ux, rz*fx-rx*fz AS uy, rx*fy-ry*fx AS uz FROM vr),
sg AS (SELECT *, greatest(1, ceil(sqrt((x2-x1)*(x2-x1)+(z2-z1)*(z2-z1))/5))::INT AS n FROM road_seg),
sp AS (SELECT struct_pack(l := line_id, s := seq, i := i) AS pt_id, line_id, seq, i AS idx, x1+(x2-x1)*(i::DOUBLE/n) AS x, z1+(z2-z1)*(i::DOUBLE/n) AS z FROM sg, LATERAL (SELECT unnest(range(0, n+1))::INT AS i) q),
{dem_sql("triangle", points="sp")}, gp AS (SELECT sp.*, h AS y FROM sp JOIN dem ON dem.pt_id=sp.pt_id WHERE h IS NOT NULL),
pr AS (SELECT v.pose_id, v.ex, v.ey, v.ez, a.line_id, a.seq, a.idx, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, {clip("a")} AS p, {clip("b")} AS q
 FROM gp a JOIN gp b ON b.line_id=a.line_id AND b.seq=a.seq AND b.idx=a.idx+1 JOIN vw v ON abs(a.x-v.ex)<600 AND abs(a.z-v.ez)<600),
pl AS (SELECT *, [p.w+p.x, p.w-p.x, p.w+p.y, p.w-p.y, p.w+p.z, p.w-p.z] AS f, [q.w+q.x, q.w-q.x, q.w+q.y, q.w-q.y, q.w+q.z, q.w-q.z] AS g FROM pr),
ct AS (SELECT *, coalesce(list_max([CASE WHEN f[i]<0 AND g[i]>=0 THEN f[i]/(f[i]-g[i]) END FOR i IN range(1,7)]), 0) AS e0, coalesce(list_min([CASE WHEN f[i]>=0 AND g[i]<0 THEN f[i]/(f[i]-g[i]) END FOR i IN range(1,7)]), 1) AS e1
 FROM pl WHERE NOT list_bool_or([f[i]<0 AND g[i]<0 FOR i IN range(1,7)])),
cl AS (SELECT *, p.x+(q.x-p.x)*e0 AS s_x, p.y+(q.y-p.y)*e0 AS s_y, p.w+(q.w-p.w)*e0 AS s_w, p.x+(q.x-p.x)*e1 AS t_x, p.y+(q.y-p.y)*e1 AS t_y, p.w+(q.w-p.w)*e1 AS t_w,
 greatest(0e0,least(1e0,coalesce(((ex-ax)*(bx-ax)+(ey-ay)*("by"-ay)+(ez-az)*(bz-az))/nullif((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)+(bz-az)*(bz-az),0),0))) AS k FROM ct WHERE e0<=e1),
sn AS (SELECT *, sqrt(pow((t_x/t_w-s_x/s_w)*{HEIGHT * ASPECT / 2},2)+pow((t_y/t_w-s_y/s_w)*{HEIGHT / 2},2)) AS pixels, sqrt(pow(ax+(bx-ax)*k-ex,2)+pow(ay+("by"-ay)*k-ey,2)+pow(az+(bz-az)*k-ez,2)) AS distance,
 exp(-3.5::DOUBLE*(pow((s_x/s_w+t_x/t_w)/2,2)+pow((s_y/s_w+t_y/t_w)/2,2))) AS mid, ax+(bx-ax)*e0 AS sx, az+(bz-az)*e0 AS sz, ax+(bx-ax)*e1 AS tx, az+(bz-az)*e1 AS tz FROM cl WHERE s_w>0 AND t_w>0),
scored AS (SELECT pose_id, line_id, sum(pixels*(12e-2+88e-2*mid)/(1+distance/800)) AS score, sum(pixels) AS pixels, min(distance) AS distance FROM sn GROUP BY 1,2 HAVING sum(pixels)>=24)"""


def seen(t):
    n = dem_rows(t)
    p = t.sql(POSE)
    poses = p.select("pose_id", "ex", "ey", "ez", *basis("fx", "fy", "fz"))
    pieces = roads.ground_steps(t.road_seg, t.dem_cell, STEP, n, n)
    return roads.seen_pieces(poses, pieces, HEIGHT, ASPECT, FOV, NEAR, FAR)


@query("t9_line_view_score", f"WITH {SEEN} SELECT pose_id, line_id, round(score,6) AS score, round(pixels,6) AS pixels, round(distance,6) AS distance FROM scored")
def _(t):
    return roads.line_view_score(seen(t)).withColumns({c: F.round(c, 6) for c in ("score", "pixels", "distance")})


#: partitions of a line, shared with its neighbour; and what a view may spend
PARTS = """SELECT line_id, CAST(floor(line_id/2e0) AS BIGINT)*2+seq AS part_id, CAST((floor(line_id/2e0)*7+seq*13)%40+10 AS BIGINT) AS bytes,
    least(x1,x2)-1 AS min_x, least(z1,z2)-1 AS min_z, greatest(x1,x2)+1 AS max_x, greatest(z1,z2)+1 AS max_z FROM road_seg"""
BUDGET = "SELECT poly_id AS pose_id, 60+poly_id%5*25 AS budget FROM domains"
SLOTS, LINK = 6, 12
LINKED = f"""en AS (SELECT line_id, x1 AS x, z1 AS z FROM road_seg WHERE seq=0 UNION ALL SELECT line_id, x2, z2 FROM road_seg WHERE seq=1),
lk AS (SELECT DISTINCT a.line_id AS a, b.line_id AS b FROM en a JOIN en b ON a.line_id<>b.line_id AND abs(a.x-b.x)<={LINK} AND abs(a.z-b.z)<={LINK} WHERE pow(a.x-b.x,2)+pow(a.z-b.z,2)<={LINK * LINK})"""
FLAT = "abs(t{0}-s{0})<1e-10"
LO, HI = ("CASE WHEN " + FLAT + " THEN {1} ELSE {2}((min_{0}-s{0})/nullif(t{0}-s{0},0),(max_{0}-s{0})/nullif(t{0}-s{0},0)) END",) * 2
#: the corridor by growing passes, and the growth as a walk that remembers all it has tried
GROWN = f"""pt AS ({PARTS}), {LINKED}, nr AS (SELECT *, row_number() OVER (PARTITION BY pose_id ORDER BY score DESC, line_id) AS rank FROM scored WHERE distance<=300),
re AS (SELECT pose_id, line_id, rank, 0 AS turn FROM nr WHERE rank=1 UNION SELECT n.pose_id, n.line_id, n.rank, re.turn+CASE WHEN re.rank<n.rank AND re.rank>1 THEN 0 ELSE 1 END FROM re JOIN lk ON lk.a=re.line_id JOIN nr n ON n.pose_id=re.pose_id AND n.line_id=lk.b AND n.rank>1 WHERE re.turn<25),
co AS (SELECT pose_id, line_id, row_number() OVER (PARTITION BY pose_id ORDER BY min(turn), rank) AS pos FROM re GROUP BY pose_id, line_id, rank),
vp AS (SELECT DISTINCT pose_id, sn.line_id, part_id, bytes FROM sn JOIN pt ON pt.line_id=sn.line_id WHERE ({FLAT.format("x")} AND sx NOT BETWEEN min_x AND max_x OR {FLAT.format("z")} AND sz NOT BETWEEN min_z AND max_z) IS NOT TRUE
 AND greatest(0, {LO.format("x", 0, "least")}, {LO.format("z", 0, "least")}) <= least(1, {HI.format("x", 1, "greatest")}, {HI.format("z", 1, "greatest")})),
cp AS (SELECT c.pose_id, c.line_id, c.pos, coalesce((SELECT list(struct_pack(p := part_id, b := bytes)) FROM vp WHERE vp.pose_id=c.pose_id AND vp.line_id=c.line_id), []) AS parts, coalesce((SELECT list(b) FROM lk WHERE a=c.line_id), []) AS near FROM co c),
cc AS (SELECT pose_id, list(struct_pack(pos := pos, line := line_id, parts := parts, near := near)) AS cands FROM cp GROUP BY 1),
st AS (SELECT c.pose_id, cands, CAST([] AS BIGINT[]) AS acc, CAST([] AS BIGINT[]) AS att, CAST([] AS BIGINT[]) AS own, budget AS lft, {SLOTS}::BIGINT AS slots, 0::BIGINT AS last, NULL::BIGINT AS line_id, NULL::BOOLEAN AS ok, NULL::BIGINT AS new_parts, NULL::BIGINT AS paid
  FROM cc c JOIN ({BUDGET}) b ON b.pose_id=c.pose_id
 UNION ALL SELECT pose_id, cands, CASE WHEN good THEN list_append(acc, nx.line) ELSE acc END, list_append(att, nx.line), CASE WHEN good THEN list_concat(own, [x.p FOR x IN nx.parts]) ELSE own END,
  CASE WHEN good THEN lft-cost ELSE lft END, CASE WHEN good THEN slots-fresh ELSE slots END, nx.pos, nx.line, good, fresh, cost
  FROM (SELECT *, len(nx.parts)>0 AND cost<=lft AND fresh<=slots AS good FROM (SELECT *, coalesce(list_sum([x.b FOR x IN nx.parts IF NOT list_contains(own, x.p)]),0)::BIGINT AS cost, len([x.b FOR x IN nx.parts IF NOT list_contains(own, x.p)]) AS fresh
   FROM (SELECT *, list_sort([struct_pack(k := c.pos+CASE WHEN c.pos<=last THEN 1000000 ELSE 0 END, pos := c.pos, line := c.line, parts := c.parts) FOR c IN cands IF NOT list_contains(att, c.line) AND (c.pos=1 OR list_has_any(c.near, acc))])[1] AS nx FROM st) q1 WHERE nx IS NOT NULL) q2) q3)"""


def planned(t):
    """The corridor of every view, what is seen of its partitions, and the links."""
    s = seen(t)
    a = t.road_seg.where("seq=0").select("line_id", F.col("x1").alias("sx"), F.col("z1").alias("sz"))
    b = t.road_seg.where("seq=1").select("line_id", F.col("x2").alias("ex"), F.col("z2").alias("ez"))
    links, parts = sel.connect_ends(a.join(b, "line_id"), float(LINK)), t.sql(PARTS)
    s = cut_lineage(s)
    found = cut_lineage(roads.corridor(roads.near_lines(roads.line_view_score(s)), links))
    return found, links, roads.seen_partitions(s, parts).join(parts.select("line_id", "part_id", "bytes"), ["line_id", "part_id"])


@query("g9_grow_corridor", f"WITH RECURSIVE {SEEN}, {GROWN} SELECT c.pose_id, c.line_id, coalesce(ok, FALSE) AS accepted, new_parts, paid FROM co c LEFT JOIN st ON st.pose_id=c.pose_id AND st.line_id=c.line_id")
def _(t):
    found, links, parts = planned(t)
    return roads.grow_corridor(found, links, parts, t.sql(BUDGET), SLOTS)
