"""Scalar functions over names, paths, ids and numbers."""

from pyspark.sql import functions as F

from landfold.catalogue import query
from landfold.functions import codecs, geometry as g, text
from landfold.operators import scoring

S_, T_ = text.SIMPLIFIED, text.TRADITIONAL
FOLD = f"translate(name,'{T_}寳','{S_}宝')"


def _named(t):
    return t.named.withColumn("aliases", F.array_compact(F.array("alias")))


@query("s1_script_fold", f"SELECT ent_no, {FOLD} AS hans, translate(name,'{S_}','{T_}') AS hant FROM named")
def _(t):
    return t.named.select("ent_no", text.script_fold("name").alias("hans"), text.script_fold("name", "zh-Hant").alias("hant"))


@query("s2_normalize_search", f"SELECT ent_no, trim(regexp_replace(lower({FOLD}),'\\s+',' ','g')) AS folded FROM named")
def _(t):
    return t.named.select("ent_no", text.normalize_search("name").alias("folded"))


@query("s3_norm_alnum", "SELECT p_partkey AS id, regexp_replace(lower(concat(p_brand,' ',p_type)),'[^a-z0-9]','','g') AS key FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), text.norm_alnum(F.concat_ws(" ", "p_brand", "p_type")).alias("key"))


HAN = "'[㐀-鿿]'"
NUM = "regexp_extract(name,'^官方未命名道路 · STREETCODE (\\d+)$',1)"
NAMES = f"""SELECT ent_no, name, alias,
 CASE WHEN {NUM}<>'' THEN 'Unnamed official road · STREETCODE '||{NUM} WHEN regexp_matches(alias,'[A-Za-z]') AND NOT regexp_matches(alias,{HAN}) THEN alias ELSE name END AS en,
 CASE WHEN {NUM}<>'' THEN '官方未命名道路 · STREETCODE '||{NUM} ELSE translate(CASE WHEN NOT regexp_matches(name,{HAN}) AND regexp_matches(alias,{HAN}) THEN alias ELSE name END,'{S_}','{T_}') END AS hant,
 CASE WHEN {NUM}<>'' THEN '官方未命名道路 · STREETCODE '||{NUM} ELSE translate(CASE WHEN NOT regexp_matches(name,{HAN}) AND regexp_matches(alias,{HAN}) THEN alias ELSE name END,'{T_}寳','{S_}宝') END AS hans
 FROM named"""


@query("s4_display_name", f"SELECT ent_no, en, hant, hans FROM ({NAMES}) q")
def _(t):
    return _named(t).select("ent_no", *[text.display_name("name", "aliases", loc).alias(n) for n, loc in
                            (("en", "en"), ("hant", "zh-Hant"), ("hans", "zh-Hans"))])


@query("s5_search_names", f"SELECT ent_no, concat_ws('|',name,alias,en,hant,hans) AS names FROM ({NAMES}) q")
def _(t):
    return _named(t).select("ent_no", F.array_join(text.search_names("name", "aliases"), "|").alias("names"))


@query("s6_classify", """SELECT p_partkey AS id, CASE WHEN p_partkey%3=0 THEN CASE p_partkey%5 WHEN 0 THEN 'elevator' WHEN 1 THEN 'stairs' WHEN 2 THEN 'entrance' WHEN 3 THEN 'connector'
  ELSE CASE WHEN p_partkey%2=0 THEN 'stairs' ELSE 'connector' END END WHEN p_partkey%3=1 THEN 'floor' ELSE 'other' END AS category FROM part""")
def _(t):
    k = F.col("p_partkey")
    sub = F.get(F.array(*[F.lit(v) for v in ("lift", "stairs", "door", "ramp")]), (k % 5).cast("int"))
    df = t.part.select(
        k.alias("id"), F.get(F.array(F.lit("connector"), F.lit("floor"), F.lit("campus")), (k % 3).cast("int")).alias("type"), sub.alias("subtype"),
        F.when(k % 2 == 0, F.array(F.lit("Staircase"), F.lit("Unknown"))).otherwise(F.array(F.lit("Staircase"), F.lit("Escalator"))).alias("source_types"),
    )
    return df.select("id", scoring.classify("type", "subtype", "source_types").alias("category"))


@query("s7_translate_message", """SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN concat('Hall ',c_name,' has ',c_nationkey,' floors') WHEN c_custkey%3=1 THEN concat(c_name,'有',c_nationkey,'层') ELSE 'missing' END AS message FROM customer""")
def _(t):
    loc = F.get(F.array(F.lit("en"), F.lit("zh-Hans"), F.lit("en")), (F.col("c_custkey") % 3).cast("int"))
    key = F.when(F.col("c_custkey") % 3 == 2, "missing").otherwise("floors")
    asked = t.customer.select(F.col("c_custkey").alias("id"), loc.alias("locale"), key.alias("key"),
                              F.create_map(F.lit("name"), "c_name", F.lit("n"), F.col("c_nationkey").cast("string")).alias("params"))
    book = {("en", "floors"): "Hall {name} has {n} floors", ("zh-Hans", "floors"): "{name}有{n}层"}
    return scoring.translate_messages(asked, book).select("id", "message")


@query("s8_resolve_locale", """SELECT doc_id, CASE WHEN lang IN ('en') THEN lang ELSE 'zh-Hans' END AS locale FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.resolve_locale("lang").alias("locale"))


@query("s9_safe_path", """SELECT path, NOT (starts_with(p,'/') OR p='' OR contains(p,'\\') OR list_has_any(string_split(p,'/'),['..','.',''])) AS safe
FROM (SELECT path, bytes, CASE WHEN bytes%4=0 THEN path WHEN bytes%4=1 THEN substring(path,2) WHEN bytes%4=2 THEN '../'||substring(path,2) ELSE 'a\\b' END AS p FROM inv_a) q""")
def _(t):
    p = (F.when(F.col("bytes") % 4 == 0, F.col("path")).when(F.col("bytes") % 4 == 1, F.expr("substring(path,2)"))
         .when(F.col("bytes") % 4 == 2, F.concat(F.lit("../"), F.expr("substring(path,2)"))).otherwise("a\\b"))
    return t.inv_a.select("path", text.safe_path(p).alias("safe"))


@query("s10_valid_sha256", "SELECT path, regexp_full_match(CASE WHEN bytes%5=0 THEN upper(sha256) ELSE sha256 END,'[a-f0-9]{64}') AS valid FROM inv_a")
def _(t):
    return t.inv_a.select("path", text.valid_sha256(F.when(F.col("bytes") % 5 == 0, F.upper("sha256")).otherwise(F.col("sha256"))).alias("valid"))


@query("s11_content_type", """SELECT path, CASE bytes%4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'model/gltf-binary' WHEN 2 THEN 'image/png' ELSE 'application/octet-stream' END AS kind FROM inv_a""")
def _(t):
    suffix = F.get(F.array(F.lit(".json"), F.lit(".glb"), F.lit(".PNG"), F.lit(".bin")), (F.col("bytes") % 4).cast("int"))
    return t.inv_a.select("path", text.content_type(F.concat("path", suffix)).alias("kind"))


@query("s12_mib_pct_ratio", """SELECT p_partkey AS id, round(p_partkey*100000/1048576e0,3) AS mib, CASE WHEN p_size%7=0 THEN NULL ELSE round(p_partkey/CAST(p_size%7 AS DOUBLE)*100,2) END AS pct,
 CASE WHEN p_size%7=0 THEN NULL ELSE round(p_partkey/CAST(p_size%7 AS DOUBLE),4) END AS ratio FROM part""")
def _(t):
    k, n = F.col("p_partkey"), F.col("p_size") % 7
    return t.part.select(k.alias("id"), codecs.mib(k * 100000).alias("mib"), codecs.pct(k, n).alias("pct"), codecs.ratio(k, n).alias("ratio"))


@query("s13_roman", "SELECT p_partkey AS id, CASE WHEN p_size<=13 THEN CAST(p_size AS BIGINT) END AS n, p_size<=13 AS known FROM part")
def _(t):
    r = text.number_to_roman("p_size")
    return t.part.select(F.col("p_partkey").alias("id"), text.roman_to_number(r).alias("n"), r.isNotNull().alias("known"))


@query("s14_epoch_parts", """SELECT event_id, CAST(floor(epoch_us(ts)/1000e0) AS BIGINT) AS ms, date_trunc('second', ts) AS at, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d FROM events""")
def _(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    at = F.timestamp_millis(ms)
    return t.events.select("event_id", ms.alias("ms"), F.date_trunc("second", at).cast("timestamp_ntz").alias("at"),
                           F.year(at).alias("y"), F.month(at).alias("m"), F.dayofmonth(at).alias("d"))


NORMAL = """n AS (SELECT tile_id, tri_idx, x1,y1,z1,x2,y2,z2,x3,y3,z3, (y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) AS nx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) AS ny, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS nz FROM tri)"""


@query("s15_vector_algebra", f"""WITH {NORMAL} SELECT tri_idx, nx, ny, nz, round(sqrt(nx*nx+ny*ny+nz*nz)/2,6) AS area, round(ny/sqrt(nx*nx+ny*ny+nz*nz),9) AS unit_y FROM n""")
def _(t):
    n = g.face_normal()
    return t.tri.select("tri_idx", *[c.alias(a) for c, a in zip(n, ("nx", "ny", "nz"))], F.round(g.face_area(), 6).alias("area"),
                        F.round(g.normalise(n)[1], 9).alias("unit_y"))


@query("s16_deep_key_search", """SELECT c_custkey AS id, c_custkey%4<2 AS bound FROM customer""")
def _(t):
    ident = F.concat(F.lit("building:"), F.col("c_custkey").cast("string"))
    k = F.col("c_custkey") % 4
    doc = (F.when(k == 0, F.concat(F.lit('{"a":[{"ownerId":"'), ident, F.lit('"}]}')))
           .when(k == 1, F.concat(F.lit('{"x":{"y":{"entityId": "'), ident, F.lit('"}}}')))
           .when(k == 2, F.concat(F.lit('{"note":"'), ident, F.lit('"}'))).otherwise(F.lit('{"ownerId":"building:"}')))
    return t.customer.select(F.col("c_custkey").alias("id"), scoring.binds_key(doc, ident, ["ownerId", "entityId"]).alias("bound"))


TRIAGE = """tr AS (SELECT p_partkey AS id, p_partkey%3=0 AS cur, p_partkey%6=0 AS rev, p_partkey%5=0 AS foc, p_partkey%7 AS missing, CASE WHEN p_size%4=0 THEN NULL ELSE 1+p_size/200e0 END AS tex, CASE WHEN p_size%3=0 THEN NULL ELSE 1+p_size/300e0 END AS tri FROM part),
sc AS (SELECT id, CAST(CASE WHEN cur THEN 5 ELSE 0 END+CASE WHEN cur AND rev THEN 2 ELSE 0 END+CASE WHEN foc THEN 3 ELSE 0 END+CASE WHEN missing>0 THEN 2 ELSE 0 END+CASE WHEN tex<11e-1 THEN 2 ELSE 0 END+CASE WHEN tri<11e-1 THEN 1 ELSE 0 END AS INTEGER) AS score,
 concat_ws(',',CASE WHEN cur THEN 'current-form' END,CASE WHEN cur AND rev THEN 'runtime-review' END,CASE WHEN foc THEN 'focus' END,CASE WHEN missing>0 THEN 'missing-owners' END,CASE WHEN tex<11e-1 THEN 'texture-gain' END,CASE WHEN tri<11e-1 THEN 'geometry-gain' END) AS reasons FROM tr)"""


def triage_input(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("id"), (k % 3 == 0).alias("current_form"), (k % 6 == 0).alias("needs_review"), (k % 5 == 0).alias("focus"), (k % 7).alias("missing_owners"),
        F.when(F.col("p_size") % 4 != 0, F.lit(1) + F.col("p_size") / 200).alias("texture_ratio"),
        F.when(F.col("p_size") % 3 != 0, F.lit(1) + F.col("p_size") / 300).alias("triangle_ratio"),
    )


@query("s17_triage_score", f"WITH {TRIAGE} SELECT id, score, reasons, CASE WHEN score>=8 THEN 'P0' WHEN score>=5 THEN 'P1' WHEN score>=3 THEN 'P2' ELSE 'P3' END AS level FROM sc")
def _(t):
    return scoring.triage(triage_input(t)).select("id", "score", F.array_join("reasons", ",").alias("reasons"), "level")


@query("s18_public_projection", "SELECT o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderstatus='O'")
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("device"), (F.col("o_orderstatus") == "O").alias("visible"))
    return scoring.public_rows(df, private=["device", "visible"])


@query("s19_decode_id_position", "SELECT c_custkey AS id, CASE WHEN c_custkey%3<>0 THEN CAST(844800+c_custkey%900-844800 AS DOUBLE) END AS x, CASE WHEN c_custkey%3<>0 THEN CAST(820500-(819900+c_custkey%700) AS DOUBLE) END AS z FROM customer")
def _(t):
    k = F.col("c_custkey")
    name = F.when(k % 3 != 0, F.concat(F.lit("obj_"), (F.lit(844800) + k % 900).cast("string"), F.lit("_"), (F.lit(819900) + k % 700).cast("string"))).otherwise("obj_plain")
    x, z = text.decode_id_position(name, 844800.0, 820500.0)
    return t.customer.select(k.alias("id"), x.alias("x"), z.alias("z"))


@query("s20_slope_and_plane", f"""WITH {NORMAL}, c AS (SELECT *, (x1+x2+x3)/3 AS px, (z1+z2+z3)/3 AS pz, (x2-x1)*(z3-z1)-(z2-z1)*(x3-x1) AS den FROM n)
SELECT tri_idx, round(degrees(acos(least(abs(ny/sqrt(nx*nx+ny*ny+nz*nz)),1e0))),6) AS slope, round(y1+((px-x1)*(z3-z1)-(pz-z1)*(x3-x1))/den*(y2-y1)+((x2-x1)*(pz-z1)-(z2-z1)*(px-x1))/den*(y3-y1),6) AS plane_y FROM c""")
def _(t):
    _, _, y = g.barycentric_xz((F.col("x1") + F.col("x2") + F.col("x3")) / 3, (F.col("z1") + F.col("z2") + F.col("z3")) / 3)
    return t.tri.select("tri_idx", F.round(g.slope_degrees(g.normalise(g.face_normal())[1]), 6).alias("slope"), F.round(y, 6).alias("plane_y"))


@query("c15_owner_id", """SELECT p_partkey AS id, CASE WHEN p_partkey%5 IN (0) THEN 'building:b'||p_partkey WHEN p_partkey%5=1 THEN 'zone:z'||p_partkey WHEN p_partkey%5=3 THEN 'building:b'||p_partkey END AS owner,
 CASE p_partkey%5 WHEN 2 THEN 'invalid-entity-id' WHEN 4 THEN CASE WHEN p_partkey%2=0 THEN 'missing-owner' ELSE 'owner-mismatch' END END AS error FROM part""")
def _(t):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    b = F.concat(F.lit("b"), s)
    m = k % 5
    e = (F.when(m == 0, F.concat(F.lit("building:"), b)).when(m == 1, F.concat(F.lit("zone:z"), s)).when(m == 2, F.lit("tower 7"))
         .when((m == 4) & (k % 2 != 0), F.lit("building:other")))
    legacy = F.when((m == 4) & (k % 2 == 0) | (m == 1), F.lit(None)).otherwise(b)
    owner, error = text.owner_id("e", "b")
    return t.part.select(k.alias("id"), e.alias("e"), legacy.alias("b")).select("id", owner.alias("owner"), error.alias("error"))
