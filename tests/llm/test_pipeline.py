"""The pipeline against its stages done plainly in order."""

import hashlib

import duckdb
import numpy as np
from test_jaccard import brute
from test_linededup import plain
from test_tiling_warc import plain_matches, words

import corpus_pipeline as P
from landfold.llm import bpe, outliers

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({outliers.oracle()}) WHERE kept").fetchall()}
    docs = [d for d in con.execute("SELECT doc_id, text FROM documents").fetchall() if d[0] in kept]
    docs = [(i, t) for i, t, *_ in plain(docs)]
    least = {i: c for i, _, c in brute(docs)}
    docs = [d for d in docs if least[d[0]] == d[0]]
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    seeds = {tuple(w[j:j + 5]) for _, t in items for w in [words(t)] for j in range(len(w) - 4)}
    near = [d for d in docs if any(tuple(w[j:j + 5]) in seeds for w in [words(d[1])] for j in range(len(w) - 4))]
    dirty = {m[0] for m in plain_matches(near, items)}
    docs = [d for d in docs if d[0] not in dirty]
    codec = bpe.Codec()
    expected = {i: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs for ids in [codec.encoding().encode_ordinary(t)]}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, SF).collect()}
    assert got == expected and 0 < len(got) < 200


def test_stages_bear_nulls_repeats_and_empty_tables(spark):
    long = "A line that many documents share, of forty characters and more."
    rows = [(i, f"{long}\n" + " ".join(f"w{i}x{j}" for j in range(80)), None if i % 2 else "en", "s", None, "clash") for i in range(8)]
    rows += [rows[0], rows[0], (None, None, None, None, None, None), (50, "", "en", None, 0, None), (None, rows[3][1], "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key_ string")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        none = stage(spark, docs.select(*P.COLUMNS).limit(0), SF)
        assert none.count() == 0
        if name != "byte_bpe":
            assert tuple(out.columns) == P.COLUMNS == tuple(none.columns) or name == "line_dedup"
            assert out.count() <= len(rows)
        else:
            assert out.count() == docs.count()
        docs = out if name != "byte_bpe" else docs
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
