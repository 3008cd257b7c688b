"""Named queries of the corpus operators over whole driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm import bpe, jaccard, katz, lengths, linededup, mixing, ordinal, outliers, phrases, ring, subsets, tiling, warc
from landfold.llm.common import table
from landfold.session import cut_lineage

SHARDS = 16


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by encoded length, with the suffix sums of every length as a context limit."""
    docs = table(spark, sf_dir, "documents", "text")
    return lengths.suffix_sums(lengths.histogram(lengths.token_lengths(docs, bpe.Codec())))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document (0 toxic, 1 poor, 2 good), the chance that it is good, and whether that is even or better."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    grade = F.expr("CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END")
    model = ordinal.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select("doc_id", grade.alias("grade")))
    good = F.element_at("tails", -1)
    return ordinal.rate(docs, model).select("doc_id", "expected_grade", good.alias("good_chance"), (good >= 0.5).alias("kept"))


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards whose counts differ by one at most."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = ring.ring_shards(rows, "doc_id", SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the robust estimate of its language and source."""
    judged = outliers.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7
    scored = katz.score(docs.withColumn("learn", fold != 2))
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), bpe.Codec())


def op7_t_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component that near copies of it make."""
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component and how many other documents it links with, equal texts among them."""
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a later one holds, after indexing all of them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    index = linededup.insert(linededup.empty_index(spark), docs)
    cleaned = linededup.clean(docs, index)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the salvage reader finds it in the archives written from the table."""
    folder, _ = warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    # these archives are whole: a gap would be a page lost, and ends the query
    sound = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.lit("an archive came back with a gap")).cast("boolean"))
    records = warc.read(warc.archives(spark, folder)).where(sound)

    def page(column):
        return F.expr(f"try_cast(regexp_extract({column}, '<urn:page:(.*)>', 1) as bigint)")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they contain, and the share of the item that their tiles cover."""
    found = tiling.matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "covered", "item_words", "coverage", F.size("tiles").alias("n_tiles"))


def op11_prefix_free_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words of each language."""
    return phrases.collocations(phrases.frequent_runs(table(spark, sf_dir, "documents", "text", "lang")))


def op12_gray_code_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of all 120 orders, per source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    marks = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    rows = subsets.with_duplicates(cut_lineage(subsets.measured(docs)))
    masked = rows.select("doc_id", "part", subsets.mask_of(subsets.failures(rows)).alias("mask"))
    return subsets.audit(subsets.cells(cut_lineage(masked), marks))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how many of its words the mix takes."""
    mixed = mixing.taken(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_ordinal_quality, op3_bounded_ring, op4_robust_outliers, op5_katz_backoff, op6_byte_bpe, op7_t_occurrence, op7_link_counts, op8_line_dedup, op9_warc_salvage, op10_string_tiling,
                                op11_prefix_free_phrases, op12_gray_code_audit, op13_source_mix)
}

OP8_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM k"""

ORACLES: dict[str, str] = {"op4_robust_outliers": outliers.oracle(), "op8_line_dedup": OP8_SQL, "op9_warc_salvage": OP9_SQL,
                           "op11_prefix_free_phrases": phrases.ORACLE, "op12_gray_code_audit": subsets.ORACLE, "op13_source_mix": mixing.ORACLE}
