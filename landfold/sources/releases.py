"""Manifests and published releases on a shared file system."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory_summary(df: DataFrame) -> DataFrame:
    """One row: files, bytes and a hash over every column that does not depend on row order or partitioning."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.coalesce(F.sum(row), F.lit(0)).cast("string"), 256).alias("digest"))


def write_manifest(df: DataFrame, path: str) -> DataFrame:
    """Write the summary next to the data and return it."""
    out = inventory_summary(df)
    out.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(out.schema).json(path)


def publish(df: DataFrame, root: str, expected_previous: str | None = None) -> str:
    """Write a release into a folder of its own, verify what was written, then switch the pointer.

    A reader sees the old release or the new one whole, also when the same content is published
    again. The switch is refused when the pointer is not the expected previous release.
    """
    spark = df.sparkSession
    digest = inventory_summary(df).first()["digest"]
    folder = f"{digest}-{uuid.uuid4().hex[:12]}"
    target = f"{root}/releases/{folder}"
    df.write.mode("error").parquet(target)
    if inventory_summary(spark.read.parquet(target)).first()["digest"] != digest:
        raise ValueError("written release differs from its digest")
    now = current_release(spark, root)
    if now != expected_previous and expected_previous is not None or (expected_previous is None and now is not None and now != digest):
        raise ValueError(f"pointer is at {now}, not at {expected_previous}")
    version = len(_pointers(spark, root)) + 1
    spark.createDataFrame([(version, digest, folder)], "version long, digest string, folder string").coalesce(1).write.mode("error").json(f"{root}/pointer/v={version:08d}")
    return digest


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str, str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    rows = spark.read.schema("version long, digest string, folder string").json(f"{root}/pointer/*").collect()
    return sorted((r["version"], r["digest"], r["folder"]) for r in rows)


def current_release(spark: SparkSession, root: str) -> str | None:
    """Digest the newest pointer names."""
    seen = _pointers(spark, root)
    return seen[-1][1] if seen else None


def _current_folder(spark: SparkSession, root: str) -> str:
    return _pointers(spark, root)[-1][2]


def read_release(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/releases/{_current_folder(spark, root)}")


def export_tiles(tiled: DataFrame, path: str) -> DataFrame:
    """Write the tiles that own a valid cell, each in a folder of its own with its halo, and read them back.

    tiled: from tile_grid(). Rows are clustered by tile before they are written, so a tile is one sorted file (or a few,
    where the writer's file size limit says so) and a reader of one tile lists one folder.
    """
    filled = tiled.where("core and h is not null").select("tile_row", "tile_col").distinct()
    rows = tiled.join(filled, ["tile_row", "tile_col"], "left_semi").repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row_no", "col_no")
    rows.write.partitionBy("tile_row", "tile_col").mode("error").parquet(path)
    return read_tiles(tiled.sparkSession, path, tiled.schema)


def read_tiles(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
