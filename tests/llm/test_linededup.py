"""Line dedup against a plain version; inserts, deletions and the filter."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np

from landfold.llm import linededup as L
from landfold.llm.queries import ORACLES, QUERIES

LONG = "a shared line of more than forty characters, number "


def plain(docs, min_docs=5):
    def lower(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(L.STRIPPED))

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(lower(line)) >= 40:
                holders[lower(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(lower(x)) >= 40 and len(holders[lower(x)]) >= min_docs and i != max(holders[lower(x)], key=lambda v: (v is not None, v)))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    docs = [(i, "\n".join(f"{' ' * (i % 3)}{LONG.upper() if i % 2 else LONG}{k}\t" for k in range(i % 7)) + f"\nown line of document {i}") for i in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, "é" * 40), (64, LONG + "3\n" + LONG + "3"), (None, LONG + "1\nx"), (5, LONG + "2"), (5, LONG + "2")]
    return docs + [(100 + i, "é" * 40 + "\r") for i in range(6)] + [(200 + i, "é" * 39) for i in range(6)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", None) for i, t in docs], "doc_id bigint, text string, keeper string, k1 string")


def cleaned(docs, index, **kw):
    return sorted(map(tuple, L.clean(docs, index, **kw).collect()), key=repr)


def test_clean_equals_plain_with_and_without_filters(spark):
    docs = corpus()
    df = frame(spark, docs)
    index = L.insert(L.empty_index(spark, shards=4), df)
    assert cleaned(df, index) == plain(docs) == cleaned(df, index, filter_bytes=-1)


def test_inserts_and_deletions_are_reversible(spark):
    docs = corpus()
    first, second = frame(spark, docs[:30]), frame(spark, docs[30:])
    one = L.insert(L.empty_index(spark, shards=4), first)
    both = L.insert(one, second)
    again = L.insert(both, second)
    refs = sorted(map(tuple, both.references.collect()))
    assert refs == sorted(map(tuple, again.references.collect())) == sorted(map(tuple, L.insert(L.empty_index(spark, shards=4), frame(spark, docs)).references.collect()))
    gone = frame(spark, [d for d in docs[30:] if d[0] != 5])
    back = L.delete(both, gone)
    kept = docs[:30] + [d for d in docs[30:] if d[0] == 5]
    assert cleaned(frame(spark, kept), back) == plain(kept)
    assert cleaned(frame(spark, kept), back, filter_bytes=-1) == plain(kept)


def test_filter_holds_grows_and_forgets():
    rng = np.random.default_rng(1)
    k = rng.integers(-2**63, 2**63 - 1, (5000, 2))
    f = L.built(k[:, 0].copy(), k[:, 1].copy())
    assert f.holds(k[:, 0].copy(), k[:, 1].copy()).all()
    other = rng.integers(-2**63, 2**63 - 1, (20000, 2))
    assert f.holds(other[:, 0].copy(), other[:, 1].copy()).mean() < 0.01
    f.remove(k[:2500, 0].copy(), k[:2500, 1].copy())
    assert f.holds(k[2500:, 0].copy(), k[2500:, 1].copy()).all() and f.holds(k[:2500, 0].copy(), k[:2500, 1].copy()).mean() < 0.01
    small = L.Cuckoo.sized(10)
    assert not small.add(k[:, 0].copy(), k[:, 1].copy())


def test_full_filter_is_rebuilt(spark):
    first = frame(spark, [(i, LONG + "0") for i in range(5)])
    many = frame(spark, [(10 + i, "\n".join(LONG + str(k) for k in range(200))) for i in range(6)])
    index = L.insert(L.insert(L.empty_index(spark, shards=1), first), many)
    docs = [(10 + i, "\n".join(LONG + str(k) for k in range(200))) for i in range(6)]
    assert index.filters.where("cells is null").count() == 0
    assert all(r[3] == (0 if r[0] == 15 else 200) for r in cleaned(frame(spark, docs), index))


def test_empty_table(spark):
    none = frame(spark, []).limit(0)
    index = L.insert(L.empty_index(spark), none)
    assert L.clean(none, index).count() == 0 and index.references.count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(ORACLES["op8_line_dedup"])
    cols = [d[0] for d in cur.description]
    rows = QUERIES["op8_line_dedup"](spark, sf).select(*cols).collect()
    assert sorted(map(tuple, rows)) == sorted(cur.fetchall())
    assert all(len(r.kept_sha256) == len(hashlib.sha256().hexdigest()) for r in rows)
