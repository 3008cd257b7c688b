"""Stored Katz models of any order against a plain recursive one."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from landfold.llm import katz, ngramtables

SCHEMA = "doc_id bigint, text string, learn boolean, n int, context string, word string, row string"


def tokens(text):
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())] + ["</s>"]


class Plain:
    def __init__(self, texts, order):
        self.order, self.c, self.total, self.after = order, Counter(), Counter(), defaultdict(set)
        for t in texts:
            words = ["<s>"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(words)):
                for n in range(1, order + 1):
                    gram = tuple(words[i - n + 1:i + 1])
                    self.c[gram] += 1
                    self.total[gram[:-1]] += 1
                    self.after[gram[:-1]].add(gram[-1])
        self.star = {n: self._star([c for g, c in self.c.items() if len(g) == n]) for n in range(1, order + 1)}
        self.unknown = 1 - sum(self.star[1](c) for g, c in self.c.items() if len(g) == 1) / self.total[()] if self.total[()] else 1.0

    @staticmethod
    def _star(counts):
        n = Counter(counts)
        top = 6 * n[6] / n[1] if n[1] else 0

        def star(r):
            if r > 5:
                return r - 0.5
            d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else 0
            return d * r if 0 < d < 1 else r - 0.5

        return star

    def p(self, context, word):
        gram = (*context, word)
        if self.c[gram]:
            return self.star[len(gram)](self.c[gram]) / self.total[context]
        if not context:
            return self.unknown
        return (self.weight(context) if self.total[context] else 1.0) * self.p(context[1:], word)

    def weight(self, context):
        seen = self.after[context]
        return (1 - sum(self.p(context, w) for w in seen)) / (1 - sum(self.p(context[1:], w) for w in seen))

    def score(self, text):
        words = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(words[i - self.order + 1:i]), words[i])) for i in range(self.order - 1, len(words)))


def some_docs(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "naïve", *[f"w{i}" for i in range(25)]]
    rows = [(i, " ".join(rng.choices(words, weights=[60, 30, 20, 10, 5, *[1] * 25], k=rng.randrange(0, 40))), rng.choice([True, True, True, False, None])) for i in range(120)]
    return [*rows, (200, None, True), (201, "", False), (None, "the of the", True), (7, "the of", True), (7, "the of", True), (202, "the unheard of the", False), (203, "the " * 4000, False)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_plain_recursion(spark, tmp_path, order):
    docs = some_docs(order)
    df = spark.createDataFrame([(*d, 1, "x", "x", "x") for d in docs], SCHEMA)
    plain = Plain([t for _, t, learn in docs if learn], order)
    folder = ngramtables.train(df, order, f"{tmp_path}/model", buckets=4)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.score) for r in ngramtables.score(df, folder).collect()), key=str)
    want = sorted(((i is None, i, len(tokens(t)), plain.score(t)) for i, t, _ in docs), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)


def test_new_texts_need_no_corpus_and_contexts_sum_to_one(spark, tmp_path):
    docs = some_docs(9)
    df = spark.createDataFrame([(*d, 1, "x", "x", "x") for d in docs], SCHEMA)
    folder = ngramtables.train(df, 3, f"{tmp_path}/model")
    plain = Plain([t for _, t, learn in docs if learn], 3)
    (new,) = ngramtables.score(spark.createDataFrame([(1, "of the w3 of nothing", "x")], "doc_id bigint, text string, n string"), folder).collect()
    assert new.score == pytest.approx(plain.score("of the w3 of nothing"))
    ngrams, contexts, summary = ngramtables.tables(spark, folder)
    assert (summary["tokens"], summary["vocabulary"]) == (plain.total[()], len(plain.after[()])) and ngrams.count() == len(plain.c)
    # seen mass, and the weight times what the shorter context leaves to the words not seen, make 1
    for context in [("the", "of"), ("<s>", "<s>"), ("the",)]:
        words = [*plain.after[()], "never"]
        assert sum(plain.p(context, w) for w in words) == pytest.approx(1.0)
    seen = ngrams.where("n > 1").groupBy("n", "context").agg(F.sum("p").alias("seen"))
    assert seen.join(contexts, ["n", "context"]).where("seen >= 1 or seen <= 0 or backoff <= 0").count() == 0
    assert seen.count() == contexts.count()


def test_bigrams_equal_op5(spark, tmp_path):
    docs = some_docs(4)
    df = spark.createDataFrame([(*d, 1, "x", "x", "x") for d in docs], SCHEMA)
    folder = ngramtables.train(df, 2, f"{tmp_path}/model")
    ours = sorted((r.n_tokens, round(r.score, 6)) for r in ngramtables.score(df, folder).collect())
    theirs = sorted((r.n_tokens, round(r.score, 6)) for r in katz.score(df.select("doc_id", "text", "learn")).collect())
    assert [o[1] for o in ours] == pytest.approx([t[1] for t in theirs], abs=1e-5)


def test_nothing_to_learn_from_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id bigint, text string, learn boolean")
    folder = ngramtables.train(df, 3, f"{tmp_path}/none")
    assert sorted((r.doc_id, r.n_tokens, r.score) for r in ngramtables.score(df, folder).collect()) == [(1, 3, 0.0), (2, 1, 0.0)]
    assert ngramtables.score(df.limit(0), folder).count() == 0


def test_a_word_of_a_third_of_all_tokens_is_spread(spark):
    """Counts are dealt by context and word together, so the rows of a hot word lie in many partitions."""
    rng = random.Random(1)
    text = " ".join(w for _ in range(3000) for w in (f"w{rng.randrange(10**6)}", f"v{rng.randrange(10**6)}", "hot"))
    df = spark.createDataFrame([(1, text, True)], "doc_id bigint, text string, learn boolean")
    grams = ngramtables.counts(df, 2).where("n = 2")
    hot = grams.groupBy("word").count().orderBy(F.desc("count")).first()
    assert hot["count"] > 2900
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = ngramtables.counts(df, 2).where(F.col("word") == hot["word"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) >= 8 and max(r["count"] for r in spread) < 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
