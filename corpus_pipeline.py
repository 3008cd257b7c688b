"""From raw documents to token ids: quality rules, line dedup, near duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it and reads it back as the docs of the
next one. All but the last return the columns of documents.

Rows with a null doc_id stay documents of their own; rows that repeat a doc_id are one document, which goes if any of
its texts is a near copy of a smaller document's, and equal ones of which one row is left after near duplicates. An
empty table gives an empty result. Further columns are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm import bpe, jaccard, linededup, outliers, tiling
from landfold.llm.common import table
from landfold.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: keys of rejected rows are sent to every task up to so many, some tens of MB; beyond, they are joined by a shuffle
SENT_KEYS = 2_000_000


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The documents whose key is not among the keys (key_) that go."""
    gone = cut_lineage(gone.distinct())
    left = docs.withColumn("key_", key)
    right = F.broadcast(gone) if gone.count() <= SENT_KEYS else gone
    return left.join(right, left["key_"].eqNullSafe(right["key_"]), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the robust estimate of their language and source."""
    docs = docs.select(*COLUMNS)
    key = F.struct("doc_id", F.xxhash64("text", "lang", "source").alias("hash"))
    judged = outliers.judge(docs.withColumn("key_", key), "key_")
    return without(docs, key, judged.where(~F.col("kept")).select("key_"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later one holds."""
    index = linededup.insert(linededup.empty_index(spark), docs)
    cleaned = linededup.clean(docs, index, carry=("lang", "source"))
    return cleaned.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of near copies, once."""
    joined = cut_lineage(jaccard.join(docs))
    kept = without(docs, F.col("doc_id"), joined.where(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key_")))
    repeated = not joined.groupBy("doc_id", "c1", "c2").count().where("count > 1").isEmpty()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return tiling.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes that they decode to."""
    return bpe.digests(docs, bpe.Codec())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("byte_bpe", encode)]

#: SQL has no greedy tiling, components or byte-level merges; tests compare run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
