"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Texts are reduced to a length where they are read; only (length, count) pairs are shuffled. The running sums are
taken inside blocks of lengths and carried over the few block totals, so no task sees more than one block.
Null texts count as empty: length 0. Repeated rows count each, and a very long text is encoded whole. An empty table gives an
empty histogram. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landfold.llm.bpe import Codec
from landfold.llm.common import slices, text_or_empty
from landfold.session import cut_lineage

BLOCK = 1024


def token_lengths(docs: DataFrame, codec: Codec, text_col: str = "text") -> DataFrame:
    """(n_tokens) for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array([len(codec.encoding().encode_ordinary(t)) for t in texts[a:b]], pa.int64())], ["n_tokens"])

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), one row per distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each distinct length L: documents and tokens of that length or more, all tokens left when texts are cut at L, and the share of documents up to L.

    docs_from, tokens_from: suffix sums. truncated_total: sum of min(length, L) over all documents.
    docs_to, share_to: documents of at most L tokens, as a count and a share of all. The histogram is written first: it is
    read three times, and the texts once.
    """
    h = cut_lineage(hist).select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("block", *[F.coalesce(F.sum(f"block_{c}").over(after), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")])
    whole = totals.agg(F.sum("block_docs").alias("all_docs"), F.sum("block_tokens").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    docs_from, tokens_from = F.sum("n_docs").over(inside) + F.col("later_docs"), F.sum("tokens").over(inside) + F.col("later_tokens")
    out = h.join(carried, "block").withColumns({"docs_from": docs_from, "tokens_from": tokens_from}).crossJoin(F.broadcast(whole))
    docs_to = F.col("all_docs") - F.col("docs_from") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from",
                      (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
                      docs_to.alias("docs_to"), (docs_to / F.col("all_docs")).alias("share_to"), "all_docs", "all_tokens")


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_total, tokens_lost) for each limit, whether or not a document has that length."""
    limit = F.explode(F.array(*[F.lit(x).cast("long") for x in limits]))
    each = hist.select("n_tokens", "n_docs", limit.alias("context_limit"))
    longer, cut = F.col("n_tokens") > F.col("context_limit"), F.least("n_tokens", "context_limit") * F.col("n_docs")
    return each.groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_longer"), F.sum(cut).alias("truncated_total"),
        (F.sum(F.col("n_tokens") * F.col("n_docs")) - F.sum(cut)).alias("tokens_lost"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that so large a share of the documents does not exceed."""
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    return sums.select("n_tokens", "docs_to", "all_docs", share.alias("share")).where("docs_to >= share * all_docs").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
