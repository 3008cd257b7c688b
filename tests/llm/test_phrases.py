"""Phrase mining against plain counting, and the parse against its promises."""

import random
import re
from collections import Counter, defaultdict

import pytest

from landfold.llm import phrases
from landfold.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n string, chunk string"


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def plain_collocations(rows, least=10, longest=3, top=2000, inside=50):
    """Everything by definition: rows are (text, lang)."""
    f, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in words_of(text):
            totals[lang] += len(piece)
            for m in range(1, longest + 1):
                f[lang].update(tuple(piece[i:i + m]) for i in range(len(piece) - m + 1))
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def some_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "naïve", "東京", "a-b", "x", "ünder", "<w>", " y"]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".\n", " ; ", "\r\n", "\x0b", "!", " \t "]
    texts = ["".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts + texts[:20]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", None) for i, (t, lang) in enumerate(rows)], SCHEMA)


def mined(runs, **limits):
    return sorted(tuple(r) for r in phrases.collocations(runs, **limits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rows = [*some_texts(seed), (None, "en"), ("", None), (" \t.\n", "fr"), ("x " * 20_000, "es"), ("Huge" * 50_000, "es")]
    assert mined(phrases.frequent_runs(frame(spark, rows))) == plain_collocations(rows)


def test_longer_runs_and_limits(spark):
    rows = some_texts(3, 60)
    docs = frame(spark, rows)
    assert mined(phrases.frequent_runs(docs, least=4, longest=4), top=7) == plain_collocations(rows, least=4, longest=4, top=7)
    assert mined(phrases.frequent_runs(docs, least=4, longest=2), inside_pct=10) == plain_collocations(rows, least=4, longest=2, inside=10)


def test_full_sieve_changes_nothing(spark):
    """A filter so small that all its bits are set lets every pair through."""
    rows = some_texts(4, 60)
    words = phrases.dictionary(frame(spark, rows))
    sieve = phrases.pair_sieve(words, 4, size=4)
    assert sieve.size == 4
    found = phrases.counts(words, sieve, 4)
    assert mined(found.where("n >= 10 OR phrase = ''")) == plain_collocations(rows)


@pytest.mark.parametrize("period,most", [(1, 4096), (3, 4096), (8, 5), (10**6, 2), (10**6, 4096)])
def test_each_run_lies_in_one_chunk(period, most):
    texts = [t.encode() for t, _ in some_texts(5, 40)] + [b"a " * 5000]
    found = list(phrases.parse(texts, 2, period, most, size=400))
    got = Counter()
    for _, chunk in found:
        pieces = [p.split(b" ") for p in chunk.split(b"\n")]
        flat = [(w, i, j) for i, p in enumerate(pieces) for j, w in enumerate(x for x in p if x)]
        closing = 0 if chunk.endswith(b"\n") else 2
        for k in range(len(flat) - closing):
            for m in (1, 2, 3):
                run = flat[k:k + m]
                if len(run) == m and len({i for _, i, _ in run}) == 1:
                    got[tuple(w for w, _, _ in run)] += 1
    want = Counter(tuple(w.encode() for w in p[i:i + m]) for t in texts for p in words_of(t.decode()) for m in (1, 2, 3) for i in range(len(p) - m + 1))
    assert got == want
    if period == 8:
        assert max(len(c.split()) for _, c in found) <= most + 2


def test_equal_passages_share_chunks(spark):
    """The cuts depend on the words around them alone, so a passage inside other texts becomes the same chunks."""
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(2000))
    rows = [(" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(50))) + " " + passage, "en") for _ in range(12)]
    words = phrases.dictionary(frame(spark, rows))
    assert words.where("n = 12").count() > 40
    assert words.count() < 12 * 6 + 80


def test_empty_table_and_long_text(spark):
    empty = frame(spark, []).limit(0)
    assert phrases.collocations(phrases.frequent_runs(empty)).count() == 0
    rng = random.Random(7)
    rows = [(" ".join(rng.choice(["ab", "cd", "ef,", "gh"]) for _ in range(700_000)), "en")]
    assert mined(phrases.frequent_runs(frame(spark, rows))) == plain_collocations(rows)


def test_query_equals_plain_counting(spark, tmp_path):
    rows = some_texts(8)
    frame(spark, rows).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_prefix_free_phrases"](spark, str(tmp_path)).collect()
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows)
