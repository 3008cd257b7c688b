"""Held-out accuracy of the ordinal classifier, and its edges."""

import numpy as np

from landfold.llm import ordinal as O
from landfold.llm.queries import QUERIES


def labelled(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    return [r.text for r in rows], np.array([0 if r.toxic else 1 if not r.quality else 2 for r in rows])


def test_held_out_grades(spark):
    texts, grade = labelled(spark, "/root/testdata/sf0.1")
    fold = np.arange(len(texts)) % 2 == 0
    model = O.fit(*O.features([t for t, f in zip(texts, fold) if f]), grade[fold])
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(model.link(*O.features([t for t, f in zip(texts, fold) if not f])))
    held = grade[~fold]
    assert (tails[0] >= tails[1]).all()
    kept = tails[1] >= 0.5
    assert kept[held == 2].mean() > 0.95 and kept[held == 1].mean() < 0.25 and kept[held == 0].mean() < 0.4
    mean = [tails.sum(axis=0)[held == k].mean() for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_query_rates_every_row(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op2_ordinal_quality"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.expected_grade <= 2 and r.kept == (r.good_chance >= 0.5) for r in rows.values())


def test_nulls_ties_empty(spark):
    docs = spark.createDataFrame([(1, "good text", "a", 1), (1, "good text", "a", 1), (2, None, None, None), (3, "", "b", 2), (None, "bad", "c", 3)], "doc_id bigint, text string, grade string, tails int")
    rated = spark.createDataFrame([(1, 2), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id bigint, grade int")
    model = O.train(docs, rated)
    rows = O.rate(docs, model).collect()
    assert len(rows) == 5 and rows[0].expected_grade == rows[1].expected_grade
    none = O.train(docs, rated.limit(0))
    assert not none.weights.any() and (np.diff(none.thresholds) > 0).all()
    assert O.rate(docs.limit(0), none).count() == 0 and O.train(docs.limit(0), rated).weights.any() == np.False_


def test_sample_is_bounded(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'x' as text")
    rated = docs.selectExpr("doc_id", "0 as grade")
    assert 300 < O.sample(docs, rated, 500).count() <= 560
