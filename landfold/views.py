"""Derived views: spatial stand-ins computed from the driver tables.

Every view grows with the tables it reads, at constant density: the world gets
wider as there are more rows, so a join's fan-out does not grow with the scale.
Coordinates are multiples of 1/8, exact in DOUBLE on every engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from landfold.plans.gridjoin import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Octagon with an optional square courtyard; fixed values of the fixture.
_RING_EDGES = [
    (0, 0, 1.0, 0.0, 0.75, 0.75), (0, 1, 0.75, 0.75, 0.0, 1.0),
    (0, 2, 0.0, 1.0, -0.75, 0.75), (0, 3, -0.75, 0.75, -1.0, 0.0),
    (0, 4, -1.0, 0.0, -0.75, -0.75), (0, 5, -0.75, -0.75, 0.0, -1.0),
    (0, 6, 0.0, -1.0, 0.75, -0.75), (0, 7, 0.75, -0.75, 1.0, 0.0),
    (1, 0, 0.25, 0.25, -0.25, 0.25), (1, 1, -0.25, 0.25, -0.25, -0.25),
    (1, 2, -0.25, -0.25, 0.25, -0.25), (1, 3, 0.25, -0.25, 0.25, 0.25),
]


def _spark_edges() -> str:
    rows = ", ".join(
        f"named_struct('ring',{r},'seq',{s},'ax',{a}D,'az',{b}D,'bx',{c}D,'bz',{d}D)"
        for r, s, a, b, c, d in _RING_EDGES
    )
    return f"LATERAL VIEW inline(array({rows})) v AS ring, seq, ax, az, bx, bz"


def _duck_edges() -> str:
    rows = ", ".join(
        f"({r},{s},CAST({a} AS DOUBLE),CAST({b} AS DOUBLE),CAST({c} AS DOUBLE),CAST({d} AS DOUBLE))"
        for r, s, a, b, c, d in _RING_EDGES
    )
    return f"CROSS JOIN (VALUES {rows}) v(ring, seq, ax, az, bx, bz)"


# {edges} and {sha}/{endsha} are the only places where the engines' texts differ.
_VIEWS: dict[str, str] = {
    "world": "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS m, CAST(ceil(sqrt(count(*))) AS BIGINT)*100 AS w FROM supplier",
    "demdim": "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM orders",
    "tridim": "SELECT CAST(ceil(sqrt(count(*)/6e0)) AS BIGINT) AS gm FROM part",
    "pts": """
        SELECT o_orderkey AS pt_id,
               ((o_orderkey*37+o_custkey*11)%(4*(SELECT w FROM world)))/4e0 AS x,
               ((o_orderkey*53+o_custkey*17)%(4*(SELECT w FROM world)))/4e0 AS z,
               ((o_orderkey*5)%240)/4e0 AS y
        FROM orders""",
    "domains": """
        SELECT s_suppkey AS poly_id, concat('building:',CAST(s_suppkey AS VARCHAR(20))) AS entity_id,
               CAST((s_suppkey%(SELECT m FROM world))*100+(s_suppkey*37)%80 AS DOUBLE) AS cx,
               CAST(CAST(floor(s_suppkey/(SELECT CAST(m AS DOUBLE) FROM world)) AS BIGINT)*100+(s_suppkey*53)%70 AS DOUBLE) AS cz,
               CAST(16+(s_suppkey%6)*8 AS DOUBLE) AS r,
               CAST((s_suppkey%7)*4 AS DOUBLE) AS min_y, CAST((s_suppkey%7)*4+40 AS DOUBLE) AS max_y
        FROM supplier""",
    "poly_edge": """
        SELECT poly_id, 0 AS part, ring, seq, cx+ax*r AS x1, cz+az*r AS z1, cx+bx*r AS x2, cz+bz*r AS z2
        FROM domains {edges}
        WHERE ring=0 OR poly_id%3=0""",
    "entities": """
        SELECT concat('campus:',CAST(r_regionkey AS VARCHAR(20))) AS entity_id, 'campus' AS type, r_name AS name, CAST(NULL AS VARCHAR(40)) AS parent_id FROM region
        UNION ALL SELECT concat('zone:',CAST(n_nationkey AS VARCHAR(20))),'zone',n_name,concat('campus:',CAST(n_regionkey AS VARCHAR(20))) FROM nation
        UNION ALL SELECT concat('building:',CAST(s_suppkey AS VARCHAR(20))),'building',s_name,concat('zone:',CAST(s_nationkey AS VARCHAR(20))) FROM supplier
        UNION ALL SELECT concat('floor:',CAST(c_custkey AS VARCHAR(20))),'floor',c_name,concat('building:',CAST(c_custkey%(SELECT count(*) FROM supplier) AS VARCHAR(20))) FROM customer
        UNION ALL SELECT concat('space:',CAST(o_orderkey AS VARCHAR(20))),CASE WHEN o_orderkey%9=0 THEN 'connector' ELSE 'space' END,
               concat('R',CAST(o_orderkey AS VARCHAR(20))),concat('floor:',CAST(o_custkey AS VARCHAR(20))) FROM orders""",
    "dem_cell": """
        SELECT row_no, col_no,
               CASE WHEN (row_no*31+col_no*17)%97=0 THEN NULL
                    ELSE ((row_no*7+col_no*13)%64)/4e0+(row_no%128)/4e0+(k%4)/8e0 END AS h
        FROM (SELECT CAST(floor(o_orderkey/(SELECT CAST(side AS DOUBLE) FROM demdim)) AS BIGINT) AS row_no,
                     o_orderkey%(SELECT side FROM demdim) AS col_no, o_custkey AS k FROM orders) c""",
    "tri_base": """
        SELECT p_partkey, CAST(floor(g/64e0) AS BIGINT)*4+p_partkey%4 AS tile_id, p_partkey%6 AS k,
               CAST((g%(SELECT gm FROM tridim))*24+(g*7)%5 AS DOUBLE) AS x0,
               CAST(CAST(floor(g/(SELECT CAST(gm AS DOUBLE) FROM tridim)) AS BIGINT)*24+(g*11)%7 AS DOUBLE) AS z0,
               CAST((g*5)%37+CASE WHEN p_partkey%11=0 THEN 50 ELSE 0 END AS DOUBLE) AS y0
        FROM (SELECT p_partkey, CAST(floor(p_partkey/6e0) AS BIGINT) AS g FROM part) b""",
    "tri": """
        SELECT tile_id, p_partkey AS tri_idx,
               x0+k-k%2 AS x1, y0+(k%3)/2e0 AS y1, z0+(k%2)*2 AS z1,
               x0+(k+1)-(k+1)%2 AS x2, y0+((k+1)%3)/2e0 AS y2, z0+((k+1)%2)*2 AS z2,
               x0+(k+2)-(k+2)%2 AS x3, y0+((k+2)%3)/2e0 AS y3, z0+((k+2)%2)*2 AS z3
        FROM tri_base""",
    "road_seg": """
        SELECT concat('path:',CAST(c_custkey AS VARCHAR(20))) AS entity_id, c_custkey AS line_id, CAST(seq AS BIGINT) AS seq,
               bx+seq*18e0 AS x1, bz+seq*(c_custkey%5-2)*4e0 AS z1,
               bx+(seq+1)*18e0 AS x2, bz+(seq+1)*(c_custkey%5-2)*4e0 AS z2,
               (c_custkey+seq)%4<>0 AS show_ground
        FROM (SELECT c_custkey, ((c_custkey*137+c_nationkey*11)%(4*(SELECT w FROM world)))/4e0 AS bx,
                     ((c_custkey*53+c_nationkey*171)%(4*(SELECT w FROM world)))/4e0 AS bz, 0 AS seq FROM customer
              UNION ALL
              SELECT c_custkey, ((c_custkey*137+c_nationkey*11)%(4*(SELECT w FROM world)))/4e0,
                     ((c_custkey*53+c_nationkey*171)%(4*(SELECT w FROM world)))/4e0, 1 FROM customer) b""",
    "mask_cell": """
        SELECT CAST(pt_id%5 AS BIGINT) AS mask_id, CAST(floor(z/8e0) AS BIGINT) AS row_no, CAST(floor(x/8e0) AS BIGINT) AS col_no,
               max(CASE WHEN pt_id%3=0 THEN 100 ELSE 255 END) AS r, max(CAST(pt_id%60 AS INTEGER)) AS g,
               max(CAST(pt_id*7%256 AS INTEGER)) AS b, max(CASE WHEN pt_id%4=0 THEN 255 ELSE CAST(pt_id%50 AS INTEGER) END) AS a
        FROM pts GROUP BY 1,2,3""",
    "budget_group": """
        SELECT p_brand AS scenario, p_partkey AS group_id, (p_partkey*7919)%1009 AS score,
               CAST(p_size*10+5 AS BIGINT) AS cost, p_partkey%17 AS item_id FROM part""",
    "inv_a": """
        SELECT concat('/',source,'/',CAST(doc_id AS VARCHAR(20))) AS path, n_chars AS bytes, {sha}text{endsha} AS sha256 FROM documents""",
    "inv_b": """
        SELECT concat('/',source,'/',CAST(doc_id AS VARCHAR(20))) AS path, n_chars+CASE WHEN doc_id%13=0 THEN 1 ELSE 0 END AS bytes,
               {sha}concat(text,CASE WHEN doc_id%13=0 THEN '!' ELSE '' END){endsha} AS sha256
        FROM documents WHERE doc_id%17<>0
        UNION ALL SELECT concat('/new/',CAST(item_id AS VARCHAR(20))), CAST(length(text) AS BIGINT), {sha}text{endsha} FROM benchmark""",
    "lod_node": """
        SELECT o_orderkey AS node_id,
               CASE WHEN o_orderkey=0 THEN NULL ELSE CAST(floor((o_orderkey-1)/4e0) AS BIGINT) END AS parent_id,
               o_orderkey%23<>7 AS available FROM orders""",
    "frames": """
        SELECT user_id AS session_id, event_id, ts, value AS latency_ms, event_type='click' AS moving FROM events""",
    "named": """
        SELECT s_suppkey AS ent_no, concat('building:',CAST(s_suppkey AS VARCHAR(20))) AS entity_id,
               CASE s_suppkey%6 WHEN 0 THEN concat('华厅 ',CAST(s_suppkey AS VARCHAR(20))) WHEN 1 THEN concat('北楼  ',CAST(s_suppkey AS VARCHAR(20)))
                    WHEN 2 THEN '图书馆' WHEN 3 THEN concat('官方未命名道路 · STREETCODE ',CAST(s_suppkey AS VARCHAR(20)))
                    WHEN 4 THEN concat('  Hall ',CAST(s_suppkey AS VARCHAR(20))) ELSE concat('體育館',CAST(s_suppkey AS VARCHAR(20))) END AS name,
               CASE WHEN s_suppkey%4=0 THEN concat('Tower ',CAST(s_suppkey AS VARCHAR(20))) WHEN s_suppkey%4=1 THEN '學生樓' ELSE NULL END AS alias
        FROM supplier""",
}
VIEW_ORDER = tuple(_VIEWS)
#: many rows from few bytes of a file: by the estimate they would be broadcast
UNPACKED = ("poly_edge", "tri_base", "tri", "road_seg")


def duck_view(name: str) -> str:
    return _VIEWS[name].replace("{edges}", _duck_edges()).replace("{sha}", "sha256(").replace("{endsha}", ")")


def spark_view(name: str) -> str:
    return (
        _VIEWS[name].replace("{edges}", _spark_edges()).replace("{sha}", "sha2(").replace("{endsha}", ",256)")
        .replace("VARCHAR(20)", "STRING").replace("VARCHAR(40)", "STRING")
    )


class Tables:
    """The driver tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._ready: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._ready:
            if name in _VIEWS:
                view = self.sql(spark_view(name))
                self._ready[name] = spread(view) if name in UNPACKED else view
            else:
                self._ready[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._ready[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in _VIEWS or name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which driver tables and views go by their own names."""
        used = [n for n in (*BASE_TABLES, *VIEW_ORDER) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text, re.I)]
        for name in used:
            self.table(name)
        for name in used:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    @cached_property
    def dem_side(self) -> int:
        return self.demdim.first()["side"]
