"""Scans of manifests, registries, features and binary assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPRESENTATION = T.StructType([T.StructField("rep_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("asset", T.StringType()),
                               T.StructField("part_indices", T.ArrayType(T.IntegerType())), T.StructField("source_dates", T.MapType(T.StringType(), T.StringType()))])
ENTITY = T.StructType([
    T.StructField("entity_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("parent_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("relations", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("target_id", T.StringType())]))),
    T.StructField("representations", T.ArrayType(REPRESENTATION)), T.StructField("_corrupt_record", T.StringType())])


def read_manifest(spark: SparkSession, path: str, schema: str | T.StructType, *explode_paths: str, multi_line: bool = True) -> DataFrame:
    """One row per innermost element: each path names an array to explode in turn, its fields promoted.

    A file is one document, or one per line.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=multi_line)
    for p in explode_paths:
        name = p.split(".")[-1]
        df = df.select(*[c for c in df.columns if c != p.split(".")[0]], F.explode(p).alias(f"_{name}"))
        inner = df.schema[f"_{name}"].dataType
        fields = [F.col(f"_{name}.{f.name}").alias(f.name if f.name not in df.columns else f"{name}_{f.name}") for f in inner.fields] if isinstance(inner, T.StructType) else [F.col(f"_{name}").alias(name)]
        df = df.select(*[c for c in df.columns if c != f"_{name}"], *fields)
    return df


def read_registry(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Entities from JSON lines. FAILFAST raises on the first malformed one; PERMISSIVE keeps it with its errors."""
    df = spark.read.schema(ENTITY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    errors = F.array_compact(F.array(
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed-json")), F.when(F.col("entity_id").isNull(), F.lit("entity_id")),
        F.when(F.col("type").isNull(), F.lit("type")), F.when(F.col("name").isNull(), F.lit("name")),
        F.when(F.exists(F.coalesce("representations", F.array()), lambda r: r["kind"].isNull() | r["rep_id"].isNull()), F.lit("representation"))))
    df = df.withColumn("errors", errors)
    if mode == "PERMISSIVE":
        return df
    checked = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("malformed entity: "), F.coalesce("entity_id", "_corrupt_record", F.lit("?"))))).otherwise(F.col("entity_id"))
    return df.withColumn("entity_id", checked.cast("string")).drop("errors", "_corrupt_record")


FEATURES = "crs STRUCT<properties: STRUCT<name: STRING>>, features ARRAY<STRUCT<properties: MAP<STRING,STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
KINDS = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>", "LineString": "array<array<double>>"}


def read_geojson(spark: SparkSession, path: str, crs: str | None = None, multi_line: bool = True) -> DataFrame:
    """Parts of polygon and line features: (feature, kind, part, ring, seq, x, y); other kinds stay as rows with NULL geometry."""
    df = spark.read.schema(FEATURES).json(path, multiLine=multi_line)
    if crs is not None:
        held = F.when(F.coalesce(F.col("crs.properties.name"), F.lit("")) == crs, F.col("features")).otherwise(F.raise_error(F.lit(f"expected {crs}")))
        df = df.withColumn("features", held.cast(df.schema["features"].dataType))
    f = df.select(F.posexplode("features").alias("feature", "f")).select("feature", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    poly, multi, line = (F.from_json("c", KINDS[k]) for k in ("Polygon", "MultiPolygon", "LineString"))
    parts = F.when(F.col("kind") == "Polygon", F.array(poly)).when(F.col("kind") == "MultiPolygon", multi).when(F.col("kind") == "LineString", F.array(F.array(line)))
    p = f.select("feature", "properties", "kind", F.posexplode_outer(parts).alias("part", "rings"))
    r = p.select("feature", "properties", "kind", "part", F.posexplode_outer("rings").alias("ring", "vs"))
    v = r.select("feature", "properties", "kind", "part", "ring", F.posexplode_outer("vs").alias("seq", "xy"))
    return v.select("feature", "properties", "kind", "part", "ring", "seq", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))


def read_gml(spark: SparkSession, path: str, row_tag: str, schema: str, pos_list: str = "posList", multi_line: bool = True) -> DataFrame:
    """Features of a GML file with their vertices: posList holds north, east, height triples; repeats of a vertex in a row collapse."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("multiLine", multi_line).schema(schema).load(path)
    n = F.transform(F.split(F.trim(pos_list), r"\s+"), lambda v: v.cast("double"))
    df = df.withColumn("_n", n)
    triple = F.transform(F.sequence(F.lit(0), (F.size("_n") / 3).cast("int") - 1), lambda i: F.struct(F.get("_n", i * 3 + 1).alias("x"), F.get("_n", i * 3).alias("y"), F.get("_n", i * 3 + 2).alias("h")))
    df = df.withColumn("_v", triple)
    kept = F.filter("_v", lambda v, i: (i == 0) | (v != F.get("_v", i - 1)))
    return df.select(*[c for c in df.columns if c not in ("_n", "_v", pos_list)], F.posexplode(kept).alias("seq", "v")).select("*", "v.x", "v.y", "v.h").drop("v")


def scan_assets(spark: SparkSession, path: str) -> DataFrame:
    """Binary scene containers: bytes, hash, and the ways each breaks the container rules."""
    a = spark.read.format("binaryFile").load(path)
    word = lambda at: F.conv(F.concat(*[F.hex(F.substring("content", at + k, 1)) for k in (3, 2, 1, 0)]), 16, 10).cast("bigint")
    json_len = word(13)
    doc = F.substring(F.col("content"), F.lit(21), json_len.cast("int")).cast("string")
    bad = F.array_compact(F.array(
        F.when(F.substring("content", 1, 4).cast("string") != "glTF", F.lit("magic")), F.when(word(5) != 2, F.lit("version")),
        F.when(word(9) != F.col("length"), F.lit("declared-length")), F.when(doc.rlike(r'"uri"\s*:\s*"(?!data:)'), F.lit("external-dependency"))))
    return a.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), bad.alias("violations"))
