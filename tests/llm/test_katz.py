"""Scores against a plain model, and probabilities that sum to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from landfold.llm import katz
from landfold.llm.queries import QUERIES

START, END = "<s>", "</s>"


def tokens(text):
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())] + [END]


def discounted(counts):
    n = Counter(counts)
    top = 6 * n[6] / n[1] if n[1] else 0

    def star(r):
        if r > 5:
            return r - 0.5
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else 0
        return d * r if 0 < d < 1 else r - 0.5

    return star


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, self.after = Counter(), Counter(), defaultdict(set)
        for t in texts:
            for a, b in zip([START, *tokens(t)], tokens(t)):
                self.words[b] += 1
                self.pairs[a, b] += 1
                self.after[a].add(b)
        self.n = sum(self.words.values())
        self.word_star, self.pair_star = discounted(self.words.values()), discounted(self.pairs.values())
        self.context = Counter()
        for (a, _), c in self.pairs.items():
            self.context[a] += c
        self.unknown = 1 - sum(self.word_star(c) for c in self.words.values()) / self.n if self.n else 1.0

    def word(self, w):
        return self.word_star(self.words[w]) / self.n if self.words[w] else self.unknown

    def weight(self, a):
        left = 1 - sum(self.pair_star(self.pairs[a, b]) for b in self.after[a]) / self.context[a]
        return left / (1 - sum(self.word(b) for b in self.after[a]))

    def probability(self, a, b):
        if self.pairs[a, b]:
            return self.pair_star(self.pairs[a, b]) / self.context[a]
        return (self.weight(a) if self.context[a] else 1.0) * self.word(b)

    def score(self, text):
        return sum(math.log10(self.probability(a, b)) for a, b in zip([START, *tokens(text)], tokens(text)))

    def base(self, text):
        return sum(math.log10((self.words[w] + 1) / (self.n + len(self.words) + 1)) for w in tokens(text))


def check(rows, docs):
    plain = Plain([t for _, t, learn in docs if learn])
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert len(rows) == len(docs)
    for i, t, learn in docs:
        r = by_id[i].pop() if len({x for k, x, _ in docs if k == i}) == 1 else next(x for x in by_id[i] if x.n_tokens == len(tokens(t)))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learnt) == (len(tokens(t)), sum(plain.words[w] > 0 for w in tokens(t)), plain.n, bool(learn))
        assert r.score == pytest.approx(plain.score(t), abs=1e-7) and r.base_score == pytest.approx(plain.base(t), abs=1e-7)
    return plain


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1.0, None) for d in docs], "doc_id bigint, text string, learn boolean, score double, block string")


def test_scores_equal_plain_model(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(5000, None, True), (5001, "", None), (5002, "New York " * 30, True), (5003, "new", False), (5004, "York yorks", False), (5002, "New York " * 30, True), (None, "x y", True), (5005, "été ÉTÉ", False)]
    plain = check(katz.score(frame(spark, docs)).collect(), docs)
    for a in [START, "new", "york", "the", "never-seen", *list(plain.context)[:20]]:
        assert sum(plain.probability(a, b) for b in [*plain.words, "never-seen-either"]) == pytest.approx(1, abs=1e-9)
    weights = {(r.n, round(r.backoff, 9)) for r in katz.model(frame(spark, docs)).collect()}
    assert weights == {(plain.context[a], round(plain.weight(a), 9)) for a in plain.context}


def test_nothing_learnt_and_empty(spark):
    rows = katz.score(frame(spark, [(1, "a b", False), (2, None, None)])).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in rows} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    assert katz.score(frame(spark, [(1, "a", True)]).limit(0)).count() == 0
    check(katz.score(frame(spark, [(1, "a", True)])).collect(), [(1, "a", True)])


def test_query_holds_out_its_fold(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_katz_backoff"](spark, sf).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [(r.score, r.base_score) for r in rows if r.held_out]
    assert sum(a for a, _ in held) > sum(b for _, b in held)


def test_many_short_texts_in_one_partition(spark):
    docs = spark.range(0, 45000, 1, 1).selectExpr("id as doc_id", "CASE WHEN id % 3 = 0 THEN 'a b' ELSE 'b' END as text", "id % 2 = 0 as learn")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    try:
        rows = katz.score(docs).groupBy("n_tokens").agg({"score": "min", "*": "count"}).collect()
        spread = katz.score(docs).groupBy("n_tokens").agg({"score": "max"}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = Plain(["a b" if i % 3 == 0 else "b" for i in range(0, 45000, 2)])
    assert {r.n_tokens: r["count(1)"] for r in rows} == {3: 15000, 2: 30000}
    for low, high in zip(sorted(rows, key=lambda r: r.n_tokens), sorted(spread, key=lambda r: r.n_tokens)):
        want = plain.score("a b" if low.n_tokens == 3 else "b")
        assert low["min(score)"] == pytest.approx(want) and high["max(score)"] == pytest.approx(want)
