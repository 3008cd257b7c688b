"""String tiling against a plain greedy search; archives round trip and salvage."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from landfold.llm import tiling as T
from landfold.llm import warc as W
from landfold.llm.queries import ORACLES, QUERIES


def plain_tiles(doc, item, least):
    """Longest common unmarked run again and again."""
    marked = [set(), set()]
    found = []
    while True:
        best = (least - 1, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in marked[0] and i + n not in marked[1]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < least:
            return found
        n, d, i = best
        marked[0] |= set(range(d, d + n))
        marked[1] |= set(range(i, i + n))
        found.append((d, i, n))


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())


def plain_matches(docs, items, least=5, coverage=0.5):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            w = words(item)
            if len(w) >= least:
                covered = sum(n for *_, n in plain_tiles(words(text), w, least))
                if covered and covered >= coverage * len(w):
                    out.add((doc_id, item_id, covered, len(w)))
    return out


def pair(seed):
    """Words of few kinds, and every other time an item made of overlapping pieces of the document."""
    rng = random.Random(seed)
    doc = [rng.randrange(4 if seed % 4 else 2) for _ in range(rng.randrange(1, 60))]
    item = [rng.randrange(4) for _ in range(rng.randrange(1, 60))]
    if seed % 2:
        doc = [rng.randrange(50) for _ in range(rng.randrange(10, 60))]
        item = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(len(doc))
            item += doc[a:a + rng.randrange(1, 14)] + [rng.choice([99, *doc])]
    return np.array(doc, np.uint64), np.array(item, np.uint64)


@pytest.mark.parametrize("block", range(8))
def test_tiles_equal_plain_search(block):
    for seed in range(50 * block, 50 * block + 50):
        doc, item = pair(seed)
        got = T.tiles(doc, item, 3)
        assert sorted(got) == sorted(plain_tiles(doc.tolist(), item.tolist(), 3)), seed


def test_reordered_item_is_found(spark):
    """The rest of a match that a longer tile overlaps is a tile too."""
    text = [f"w{i}" for i in range(1, 13)]
    item = " ".join([*text[5:], "x", *text[:6], *(f"z{i}" for i in range(6))])
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "w1 w2 w3 w4 w5 w7")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    found = T.matches(docs, bench).collect()
    assert [(r.doc_id, r.covered, r.item_words, [tuple(t) for t in r.tiles]) for r in found] == [(1, 12, 20, [(0, 8, 5), (5, 0, 7)])]
    assert [r.doc_id for r in T.clean(docs, bench).collect()] == [2]


def corpus():
    rng = random.Random(5)
    vocab = [f"tok{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 20, 45])))) for k in range(12)] + [(50, None), (51, ""), (52, "one two"), (None, " ".join(vocab[:30]))]
    docs = []
    for k in range(60):
        body = rng.choices(vocab, k=rng.randrange(5, 120))
        if k % 3 == 0:
            w = items[k % 12][1].split()
            if k % 2:
                cut = len(w) // 2
                w = w[cut:] + ["between"] + w[:cut]
            body[len(body) // 2:len(body) // 2] = w
        text = " ".join(body)
        docs.append((k, text.upper() + "!" if k % 5 == 0 else text.replace(" ", ", ")))
    return docs + [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1]), (None, items[3][1]), (103, " ".join(vocab[:30]))], items


def test_matches_and_clean_equal_plain(spark, monkeypatch):
    docs, items = corpus()
    expected = plain_matches(docs, items)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, item_id int, tiles string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    for block in (8 << 20, 200):
        got = [(r.doc_id, r.item_id, r.covered, r.item_words) for part in [T.matches(df, bench)] for r in part.collect()]
        assert set(got) == expected and len(got) == len(expected) + sum(1 for e in expected if e[0] == 102)
        monkeypatch.setattr(T.blocks, "__defaults__", (block,))
    kept = [(r.doc_id, r.text) for r in T.clean(df, bench).collect()]
    assert sorted(kept, key=repr) == sorted([d for d in docs if d[0] not in {e[0] for e in expected}], key=repr)
    assert T.clean(df, bench).columns == df.columns
    assert T.matches(df.limit(0), bench).count() == 0 and T.matches(df, bench.limit(0)).count() == 0 and T.clean(df, bench.limit(0)).count() == len(docs)


def test_tiling_query_finds_the_benchmark(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.covered, r.item_words) for r in QUERIES["op10_string_tiling"](spark, sf).collect()}
    seeds = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in docs)}
    meeting = [(d, i) for d in docs for i in items if not seeds[d[0]].isdisjoint(tuple(w[k:k + 5]) for w in [words(i[1])] for k in range(len(w) - 4))]
    assert got == set().union(*[plain_matches([d], [i]) for d, i in meeting if len(d[1]) < 3000 or (d[0], i[0]) in {g[:2] for g in got}])
    assert got


PAGES = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, None), (4, "http://d\r\nInjected: y", "short"), (5, "http://e", "short"), (6, "http://f", "é" * 600),
         (7, "http://g", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (7, "http://g", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (None, "http://n", "x" * 1500), (8, "http://h", "z\r\n\r\n" + "y" * 2000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash", 9) for p in PAGES], "page_id bigint, url string, html string, refers_to string, payload int")
    folder, manifest = W.write(df, segment_bytes=2000)
    rows = W.read(W.archives(spark, folder)).collect()
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) == len(PAGES) and all(r.kind == "record" for r in rows)
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        r = next(r for r in rows if r.record_id == W.page_urn(page_id))
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest()
        if page_id == 1:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", W.page_urn(2), None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
    empty, _ = W.write(df.limit(0))
    assert W.with_revisits(df.limit(0)).count() == 0


def raw_records():
    return [W.record(i, f"http://{i}", bytes(random.Random(i).choices(range(256), k=3000)), None) for i in range(8)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "front", "lost", "none", "tail"])
def test_salvage_recovers_the_rest_and_logs_the_gap(packed, damage):
    parts = [W.member(r) if packed else r for r in raw_records()]
    whole = b"".join(parts)
    start, end = len(b"".join(parts[:3])), len(b"".join(parts[:4]))
    spoiled = {"flip": whole[:start + 900] + bytes([whole[start + 900] ^ 255]) + whole[start + 901:], "cut": whole[:end - 700] + whole[end:], "junk": whole[:end] + b"junk \x1f\x8b\x08 WARC/1.0 junk" + whole[end:],
               "front": b"\x00\x01" + whole, "lost": whole[:start] + b"\xff" * (end - start) + whole[end:], "none": whole, "tail": whole[:-5]}[damage]
    rows = list(W.salvaged(spoiled))
    ids = [r["record_id"] for r in rows if r["kind"] == "record"]
    gone = {"flip": {3}, "cut": {3}, "lost": {3}, "tail": {7}}.get(damage, set())
    assert ids == [W.page_urn(i) for i in range(8) if i not in gone]
    spans = [(r["start"], r["end"]) for r in rows]
    assert spans[0][0] == 0 and spans[-1][1] == len(spoiled) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert len(gaps) == (damage != "none") and all(g["reason"] for g in gaps)


def test_salvage_of_nothing_and_of_noise():
    assert list(W.salvaged(b"")) == []
    noise = bytes(random.Random(1).choices(range(256), k=50000))
    assert [(r["kind"], r["start"], r["end"]) for r in W.salvaged(noise)] == [("gap", 0, 50000)]


def test_warc_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cur = con.execute(ORACLES["op9_warc_salvage"])
    cols = [d[0] for d in cur.description]
    ours = QUERIES["op9_warc_salvage"](spark, sf).select(*cols).collect()
    assert sorted(map(tuple, ours), key=repr) == sorted(cur.fetchall(), key=repr)


def test_long_headers_and_members_of_several_records_are_salvaged():
    long = W.record(1, "data:" + "x" * 200_000, b"page", None)
    assert [r["kind"] for r in W.salvaged(W.member(long))] == ["record"]
    rng = random.Random(5)
    several = [W.record(k, f"u{k}", rng.randbytes(3000), None) for k in range(5)]
    broken = several[2].replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A")
    found = list(W.salvaged(W.member(b"".join([*several[:2], broken, *several[3:]]))))
    assert [r.get("record_id") for r in found] == [W.page_urn(0), W.page_urn(1), None, W.page_urn(3), W.page_urn(4)]
    assert "inner bytes" in found[2]["reason"]
    packed = W.member(b"".join(several))
    found = list(W.salvaged(packed[:-2000] + W.member(long)))
    assert [r["record_id"] for r in found if r["kind"] == "record"] == [W.page_urn(k) for k in (0, 1, 2, 3, 1)]
    assert any(r["kind"] == "gap" for r in found)
