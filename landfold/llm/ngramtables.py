"""Katz models of any order as stored tables, by which new texts are scored without the corpus.

train() writes three tables under a folder:

* ngrams (n, bucket, context, word, c, p): each n-gram of 1 to `order` words that occurs, its count and its discounted
  probability after its context, partitioned by n and by bucket of the context;
* contexts (n, bucket, context, total, backoff): each context of n - 1 words, its count and its backoff weight;
* summary (order, buckets, tokens, texts, vocabulary, unknown): one row.

Contexts and words are 64-bit hashes of the words as op5 takes them; a text begins after order - 1 starts and ends with
one end. Counts up to K have Katz's discount from the counts of counts of their n, others lose ABOVE (katz.discounts).
A context's weight is what its n-grams leave over what the next shorter context leaves to the words not seen after it; an
n-gram's lower one was seen too, so that is one join of each n with n - 1. Whatever the order, each context's
probabilities sum to 1.

score() evaluates the recursion by one left join per order for the different n-grams of the new texts, which are few
beside their occurrences: found at n, or else the weight of the context (1 if it was never seen) and on to n - 1, down to
the unknown word. Then occurrences take their value and are added up per text.

n-grams combine in each task and again before every shuffle, and are dealt by context and word together: a context or a
word with a third of all tokens is spread by what stands beside it. Joins on n-grams feed a grouping, so that AQE may
split what is still crowded. op5_katz_backoff does not use these tables: its packed bigrams need a fifth of the disk.

Null and empty texts are one end token. Rows are learnt from where learn is true (null: not). Repeated rows count, and
are scored, each. Without any row to learn from every token has probability 1; an empty table gives no rows. Columns
other than doc_id, text and learn are not read. Texts are taken a slice at a time, a very long one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm.common import U64, Words, chain, slices
from landfold.llm.katz import ABOVE, END, START, K, discounts
from landfold.session import cut_lineage

BUCKETS = 64
GRAM = "n int, context bigint, word bigint, shorter bigint"


def _grams(texts: list[str | None], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, context, word, next shorter context, number of the text) of every token, for each n."""
    words = Words(texts)
    tokens = np.insert(words.hash, words.first[1:], END)
    size = np.diff(words.first) + 1
    text = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(tokens)) - (np.cumsum(size) - size)[text]
    before = [np.where(place >= k, np.roll(tokens, k), START) for k in range(1, order)]
    contexts = [np.zeros(len(tokens), U64), *[chain(before[n - 2::-1]) for n in range(2, order + 1)]]
    for n in range(1, order + 1):
        yield n, contexts[n - 1], tokens, contexts[max(0, n - 2)], text


def _signed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


def counts(docs: DataFrame, order: int) -> DataFrame:
    """(GRAM, c): n-grams of the rows to learn from and how often they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                for n, context, word, shorter, _ in _grams(texts[a:b], order):
                    _, first, c = np.unique(chain([context, word]), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n, np.int32)), *_signed(context[first], word[first], shorter[first]), pa.array(c.astype(np.int64))], ["n", "context", "word", "shorter", "c"])

    rows = docs.where("learn").select("text").mapInArrow(run, f"{GRAM}, c bigint")
    return rows.groupBy("n", "context", "word", "shorter").agg(F.sum("c").alias("c"))


def _discounted(c: Column, stars: np.ndarray) -> Column:
    return F.when(c <= K, F.element_at(F.array(*[F.lit(float(x)) for x in stars[1:]]), c.cast("int"))).otherwise(c - ABOVE)


def train(docs: DataFrame, order: int, folder: str, buckets: int = BUCKETS) -> str:
    """Write the tables of a model of the rows of docs (doc_id, text, learn) to learn from; the folder."""
    learnt = docs.select("doc_id", "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    grams = cut_lineage(counts(learnt, order))
    level = F.least(F.col("c"), F.lit(K + 2))
    found = {(r["n"], r["r"]): r["k"] for r in grams.groupBy("n", level.alias("r")).agg(F.count("*").alias("k")).collect()}  # order * (K + 2) numbers
    stars = {n: discounts(np.array([0, *[found.get((n, r), 0) for r in range(1, K + 3)]])) for n in range(1, order + 1)}
    whole = grams.where("n = 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("vocabulary"), F.coalesce(F.sum(_discounted(F.col("c"), stars[1])), F.lit(0.0)).alias("kept")).first()
    unknown = 1 - whole["kept"] / whole["tokens"] if whole["tokens"] else 1.0
    at = F.pmod("context", F.lit(buckets)).cast("int").alias("bucket")
    lower = None
    for n in range(1, order + 1):
        mine = grams.where(F.col("n") == n)
        total = mine.groupBy("context").agg(F.sum("c").alias("total"))
        p = cut_lineage(mine.join(total, "context").withColumn("p", _discounted(F.col("c"), stars[n]) / F.col("total")).select("context", "word", "shorter", "c", "total", "p"))
        p.select(at, "context", "word", "c", "p").repartition(buckets, "bucket").sortWithinPartitions("bucket", "context", "word").write.partitionBy("bucket").parquet(f"{folder}/ngrams/n={n}")
        if lower is not None:
            beside = lower.select(F.col("context").alias("shorter"), "word", F.col("p").alias("p_lower"))
            weights = p.join(beside, ["shorter", "word"]).groupBy("context").agg(F.max("total").alias("total"), ((F.lit(1.0) - F.sum("p")) / (F.lit(1.0) - F.sum("p_lower"))).alias("backoff"))
            weights.select(at, "context", "total", "backoff").repartition(buckets, "bucket").sortWithinPartitions("bucket", "context").write.partitionBy("bucket").parquet(f"{folder}/contexts/n={n}")
        lower = p
    row = [(order, buckets, whole["tokens"], learnt.where("learn").count(), whole["vocabulary"], unknown)]
    docs.sparkSession.createDataFrame(row, "order int, buckets int, tokens bigint, texts bigint, vocabulary bigint, unknown double").coalesce(1).write.parquet(f"{folder}/summary")
    return folder


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None, dict]:
    """N-grams, contexts (None for order 1) and the summary of a stored model."""
    summary = spark.read.parquet(f"{folder}/summary").first().asDict()
    ngrams = spark.read.schema("context bigint, word bigint, c bigint, p double, n int, bucket int").parquet(f"{folder}/ngrams")
    contexts = spark.read.schema("context bigint, total bigint, backoff double, n int, bucket int").parquet(f"{folder}/contexts") if summary["order"] > 1 else None
    return ngrams, contexts, summary


def score(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, score): the log10 probability of each row's text by a stored model."""
    spark = docs.sparkSession
    ngrams, contexts, summary = tables(spark, folder)
    order = summary["order"]
    rows = cut_lineage(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    names = [f"c{n}" for n in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("row").to_numpy()
            for a, b in slices(texts):
                made = list(_grams(texts[a:b], order))
                word, text = made[0][2], made[0][4]
                _, first, times = np.unique(chain([made[-1][1], word, text.astype(U64)]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + text[first]]), pa.array(times.astype(np.int64)), *_signed(word[first], *[g[1][first] for g in made])], ["row", "times", "word", *names])

    schema = "row bigint, times bigint, word bigint, " + ", ".join(f"{c} bigint" for c in names)
    held = cut_lineage(rows.select("row", "text").mapInArrow(run, schema))
    last = names[-1]
    todo = held.select("word", *names).dropDuplicates(["word", last]).withColumns({"log": F.lit(0.0), "done": F.lit(False)})
    for n in range(order, 0, -1):
        known = ngrams.where(F.col("n") == n).select(F.col("context").alias(f"c{n}"), "word", F.log10("p").alias("found"))
        step = todo.join(known, [f"c{n}", "word"], "left")
        if n > 1:
            weight = contexts.where(F.col("n") == n).select(F.col("context").alias(f"c{n}"), F.log10("backoff").alias("weight"))
            step = step.join(weight, f"c{n}", "left")
        else:
            step = step.withColumn("weight", F.lit(float(np.log10(summary["unknown"]))))
        gain = F.when(F.col("done"), 0.0).otherwise(F.coalesce("found", "weight", F.lit(0.0)))
        todo = cut_lineage(step.select("word", *names, (F.col("log") + gain).alias("log"), (F.col("done") | F.col("found").isNotNull()).alias("done")))
    each = held.join(todo.select("word", last, "log"), ["word", last])
    sums = each.groupBy("row").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("log")).alias("score"))
    return rows.select("doc_id", "row").join(sums, "row").select("doc_id", "n_tokens", "score")

