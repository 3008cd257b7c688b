"""The filter audit and the source mix against plain versions."""

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from landfold.llm import mixing, subsets
from landfold.llm.queries import QUERIES

TEXTS = [None, "", " ", "a b " * 150, "A#b " * 150, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}" for i in range(300)), "short $ one", "x" * 70_000, "short"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, mask int, size string, rate double, row string"


def some_docs(seed, n=200):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, None, 7]), rng.choice(TEXTS), "en", rng.choice(["s1", "s2", "", None, "ß"]), None, "clash", 9, "clash", None, "clash") for i in range(n)]
    return rows + rows[:20]


def some_labels(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice([i, i, 7, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(n)]


def plain_audit(docs, labels):
    """Every order applied one document at a time."""
    good, toxic = ({i for i, *v in labels if i is not None and v[j] == 1} for j in (0, 1))
    smallest = {}
    for i, t, *_ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))

    def failed(i, t):
        words = (t or "").encode().split()
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t or "") > 2 * len(t or ""),
                "D": any(c in "#$%&*|" for c in t or ""), "E": i is not None and i > smallest[t or ""]}

    parts = defaultdict(list)
    for i, t, _, s, *_ in docs:
        parts[s or ""].append((failed(i, t), i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        table, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                shapley[x] += len(gone)
                table.append((part, "".join(order), step, len(left), len(gone), sum(r[0][x] for r in rows) - len(gone), sum(r[0][x] and sum(r[0].values()) == 1 for r in rows),
                              sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in table]
    return sorted(out)


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_plain_orders(spark, tmp_path, seed):
    docs, labels = some_docs(seed), some_labels(seed)
    got = QUERIES["op12_gray_code_audit"](spark, write(spark, tmp_path, docs, labels))
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    assert QUERIES["op12_gray_code_audit"](spark, folder).count() == 0
    assert QUERIES["op13_source_mix"](spark, folder).count() == 0


@pytest.mark.parametrize("n", [1, 3, 6])
def test_walk_equals_counting_each_subset(n):
    rng = random.Random(n)
    cell = {mask: (rng.randrange(9), rng.randrange(9)) for mask in range(1 << n) if rng.random() < 0.7} or {0: (1, 1)}
    got = subsets.walk(cell, n)
    for state in range(1 << n):
        assert got[state] == tuple(sum(c[j] for mask, c in cell.items() if not mask & state) for j in (0, 1))


def test_words_of_long_texts_are_taken_in_pieces():
    raw = b"ab  cd\tef ab\n" * 3000 + b"x" * 5000 + b" end"
    assert subsets.word_numbers(raw, 100) == (len(raw.split()), len(set(raw.split())))
    assert subsets.word_numbers(b"", 100) == (0, 0) and subsets.word_numbers(b"x" * 1000, 100) == (1, 1)


def plain_targets(totals, weights=(3, 1, 2), share=1.5, most=2.0):
    """By resharing the excess until no source is above its cap."""
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(totals.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * totals[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * totals[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed,share", [(1, 1.5), (2, 1.5), (3, 0.2), (4, 2.0)])
def test_targets_equal_resharing(spark, seed, share):
    rng = random.Random(seed)
    totals = {s: rng.choice([0, 1, 10, 10**4, 10**7]) * rng.randrange(1, 50) for s in [None, "", *(f"s{i}" for i in range(40)), "é", "z\U0001F600", "z￮"]}
    rows = [(s, n - n // 3) for s, n in totals.items()] + [(s, n // 3) for s, n in totals.items()]
    got = mixing.source_rates(spark.createDataFrame(rows, "source string, size bigint"), share=share).collect()
    want = plain_targets(totals, share=share)
    assert {r.source: r.source_size for r in got} == totals
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.rate == (r.target / r.source_size if r.source_size else 0.0) and r.rate <= 2


def test_mix_emits_what_it_counts(spark, tmp_path):
    docs = spark.createDataFrame(some_docs(5), SCHEMA)
    rows = mixing.taken(docs).collect()
    assert len(rows) == 220 and all(r.taken == r.copies * r.size and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.copies <= 2 for r in rows)
    assert all(r.size == len((t or "").encode().split()) for r, t in zip(sorted((r for r in rows if r.doc_id is None), key=lambda r: r.size),
                                                                        sorted((d[1] for d in some_docs(5) if d[0] is None), key=lambda t: len((t or "").encode().split()))))
    rates = mixing.source_rates(mixing.sized(docs))
    for sent in (1000, 0):  # rates sent to all tasks, and joined by a salted shuffle
        mixed = mixing.mix(docs, rates, sent=sent)
        assert mixed.columns == docs.columns
        assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +Counter({(k, s): sum(r.copies for r in rows if (r.doc_id, r.source) == (k, s)) for k, s in {(r.doc_id, r.source) for r in rows}})
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, rows))


def test_taken_words_come_near_targets(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 60), rng.choice("abcdef")) for i in range(6000)], "doc_id bigint, text string, source string")
    by = defaultdict(list)
    for r in mixing.taken(docs).collect():
        by[r.source].append(r)
    for rows in by.values():
        p = rows[0].rate % 1
        spread = math.sqrt(p * (1 - p) * sum(r.size**2 for r in rows))
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 4 * spread + 1
