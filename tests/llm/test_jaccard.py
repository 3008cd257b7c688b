"""The join against brute force: random near copies, chains, common passages, short and empty texts, large groups."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from landfold.llm import jaccard as J
from landfold.llm.queries import QUERIES


def brute(docs):
    sets = []
    for _, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    for k, own in enumerate(sets):
        for other, both in Counter(o for s in own for o in lists[s]).items():
            if 100 * both >= 80 * (len(own) + len(sets[other]) - both):
                parent[root(other)] = root(k)
        for s in own:
            lists[s].append(k)
    members = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        members[root(k)].append(i)
    return sorted(((i, len(sets[k]), min((x for x in members[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(docs)), key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(n // 4):
        base = rng.choices(vocab, k=rng.choice([3, 5, 6, 12, 40, 120, 300]))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2:]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            near = list(texts[-1] if rng.random() < 0.5 else base)
            for _ in range(rng.randrange(1 + len(near) // 25)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(near)
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(docs)
    docs += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "Hello"), (9005, "hello "), (9006, "a b c d"), (9007, "a b c d e"), (9008, "A\nB\x0bc\td"), (None, docs[0][1]), (docs[1][0], docs[1][1]), (docs[2][0], docs[3][1])]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], "doc_id bigint, text string, n bigint, c1 string, cid string")


@pytest.mark.parametrize("part", [4096, 8])
def test_join_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(J, "PART", part)
    docs = corpus(part)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(frame(spark, docs)).collect()), key=repr)
    assert got == brute(docs)


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(frame(spark, docs)).collect()), key=repr)
    assert got == brute(docs)


@pytest.mark.parametrize("seed", range(6))
def test_divide_skip_joins_what_brute_force_joins(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            near = base.copy()
            change = rng.random(len(near)) < rng.choice([0.0, 0.05, 0.12, 0.3])
            near[change] = rng.integers(0, 2**63, change.sum())
            sets.append(np.unique(near))
    sets.append(np.zeros(0, np.uint64))
    found = J.divide_skip(sets, np.arange(len(sets)))
    assert all(J.linked(sets[i], sets[j]) for i, j in found)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in found:
        parent[root(i)] = root(j)
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and J.linked(sets[i], sets[j]):
                assert root(i) == root(j)


def test_empty_table_and_query(spark):
    assert J.join(frame(spark, []).limit(0)).count() == 0
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op7_t_occurrence"](spark, sf).collect()), key=repr)
    assert got == brute(docs)


def link_counts(docs):
    """(doc_id, links) by brute force over rows."""
    sets = []
    for _, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = [0] * len(docs)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                n[i] += 1
                n[j] += 1
    return sorted(((i, k) for (i, _), k in zip(docs, n)), key=repr)


@pytest.mark.parametrize("part", [4096, 8])
def test_every_link_is_counted(spark, monkeypatch, part):
    monkeypatch.setattr(J, "PART", part)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    docs = corpus(part + 1, 200)
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        docs.append((20000 + k, " ".join(words)))
    got = sorted(((r.doc_id, r.n_links) for r in J.join(frame(spark, docs)).collect()), key=repr)
    assert got == link_counts(docs)


def test_link_query_counts_every_link(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_links) for r in QUERIES["op7_link_counts"](spark, sf).collect()), key=repr)
    assert got == link_counts(docs)
