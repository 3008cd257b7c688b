"""Session building and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "landfold", cpus: str | int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints; a scratch one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write the rows to a table in the shared checkpoint folder and read them back.

    Survives the loss of executors, ends the lineage, and gives the next plan
    true sizes; a checkpointed RDD would also carry the old plan's constraints
    along, which grow with every round of a loop. replaces: the cut table of the
    round before, which nothing else reads; it is deleted once this one is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/landfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None and (old := replaces.__dict__.get("cut_path")):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["cut_path"] = path
    return out
