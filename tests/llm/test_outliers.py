"""Base statistics against a plain count, verdicts against labels and the SQL twin."""

import random
import re
from collections import Counter

import duckdb

from landfold.llm import outliers
from landfold.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, level string, n_words string, x0 string"
TEXTS = [None, "", "  \n\t\n", "one", "a b", "a b c", "a b c a b c", "x\ny\nx\nx\n\n\n", "p q r s p q r t p q r\nz", "## $ % & | <> *a", "été été été été",
         "w " * 200, "line one here\n" * 30, " ".join(f"w{i}" for i in range(300)), "\x0bA\x0cB\rC\x1cD E"]


def plain(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_statistics_and_nulls(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", None, None, "c", None, "c", "c") for i, t in enumerate(TEXTS)] + [(None, "dup", None, None, None, None, None, None, None)] * 2, SCHEMA)
    rows = outliers.judge(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert not (r.kept and r.base_failed)
    assert outliers.judge(df.limit(0)).count() == 0


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = outliers.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(ORACLES["op4_robust_outliers"])
    cols = [d[0] for d in cur.description]
    ours = QUERIES["op4_robust_outliers"](spark, sf).select(*cols).collect()
    assert sorted(map(tuple, ours)) == sorted(cur.fetchall())


def plain_text(rng, symbols=0.0):
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(rng.randrange(80, 160))]
    words = [w[:-1] + "#" * (1 + len(w) // 4) if rng.random() < symbols else w for w in words]
    return "\n".join(" ".join(words[i:i + 8]) for i in range(0, len(words), 8))


def kept_ids(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    rows = outliers.judge(df).collect()
    assert not any(r.base_failed for r in rows)
    return {r.doc_id for r in rows if r.kept}


def test_repeated_lines_alone_reject(spark):
    rng = random.Random(1)
    texts = [plain_text(rng) for _ in range(200)]
    unique = plain_text(rng).split("\n")[:10]
    texts.append("\n".join(line for x in unique for line in (x, "repeat")))  # 9 of 20 lines are repeated, no words in threes are
    assert kept_ids(spark, texts) == set(range(200))


def test_source_with_forty_percent_bad_rows(spark):
    rng = random.Random(2)
    texts = [plain_text(rng) for _ in range(180)] + [plain_text(rng, 0.95) for _ in range(120)]
    assert kept_ids(spark, texts) == set(range(180))
