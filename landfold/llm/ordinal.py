"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = 1 / (1 + exp(w.x - t_k)) with one weight vector w for all grades and ordered thresholds t_0 < t_1 < ...
A text's features x are which words it has (punctuation stripped, A-Z lower-cased), which endings of two bytes its
words have, and the tenth in which its share of different words lies, each hashed to one of 2**BITS weights and counted
once. Thresholds are kept in order by learning the first
and the logarithms of the steps.

The model is fitted on a sample of at most SAMPLE_ROWS labelled rows, drawn by the hash of doc_id so that only the drawn
texts are joined with their labels; the driver gets their feature numbers. Every row is then scored where it is read,
with the weights (4 MB) sent to the tasks.

Rows without a label or with a null one teach nothing; a label given several times is the lowest. Null and empty texts have
no features and get the grade of the thresholds alone. If no row is labelled, all weights are zero and the thresholds
even. Repeated rows are each scored. An empty table gives no rows. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import U64, Words, mix, slices

BITS = 19
SAMPLE_ROWS = 20_000
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.15, 2e-5
LEAST_TEXTS = 3
GRADES = 3


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after another, and where each text's begin; none twice in a text."""
    index, counts = [], []
    for a, b in slices(texts):
        plain, marked = Words(texts[a:b], ascii_marks=True), Words(texts[a:b])
        ends = mix(marked.tail.astype(U64) + U64(1 << 32))
        different = np.unique(plain.text.astype(U64) << U64(40) | plain.hash >> U64(24)) >> U64(40)
        share = 10 * np.bincount(different.astype(np.int64), minlength=b - a) // np.maximum(1, np.diff(plain.first))
        variety = mix(share.astype(U64) + U64(1 << 33))
        text = np.concatenate([plain.text, marked.text, np.arange(b - a)]).astype(U64)
        number = np.concatenate([plain.hash, ends, variety]) >> U64(64 - bits)
        both = np.unique(text << U64(bits) | number)
        index.append((both & U64((1 << bits) - 1)).astype(np.int32))
        counts.append(np.bincount((both >> U64(bits)).astype(np.int64), minlength=b - a))
    flat = np.concatenate(index) if index else np.zeros(0, np.int32)
    return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def link(self, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=float)])
        return sums[starts[1:]] - sums[starts[:-1]]

    def tails(self, link: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in rows."""
        return _sigmoid(link[None, :] - self.thresholds[:, None])


def fit(index: np.ndarray, starts: np.ndarray, grade: np.ndarray, grades: int = GRADES, bits: int = BITS) -> Model:
    """Adaptive gradient steps on the likelihood; features in fewer than LEAST_TEXTS texts keep weight zero."""
    rng = np.random.default_rng(7)
    weights, squares = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
    raw, raw_squares = np.concatenate([[-1.0], np.zeros(grades - 2)]), np.full(grades - 1, 1e-2)
    common = np.bincount(index, minlength=1 << bits) >= LEAST_TEXTS

    def thresholds():
        return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))

    for _ in range(EPOCHS if len(grade) else 0):
        order = rng.permutation(len(grade))
        for low in range(0, len(order), BATCH):
            rows = order[low:low + BATCH]
            size = starts[rows + 1] - starts[rows]
            flat = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            own, row = index[flat], np.repeat(np.arange(len(rows)), size)
            link = np.bincount(row, weights=weights[own], minlength=len(rows))
            t, y = thresholds(), grade[rows]
            upper = np.where(y < grades - 1, _sigmoid(t[np.minimum(y, grades - 2)] - link), 1.0)
            lower = np.where(y > 0, _sigmoid(t[np.maximum(y - 1, 0)] - link), 0.0)
            chance = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            slope = (du - dl) / chance
            at, back = np.unique(own, return_inverse=True)
            step = np.bincount(back, weights=slope[row]) / len(rows) + SHRINK * weights[at]
            step *= common[at]
            squares[at] += step ** 2
            weights[at] -= RATE * step / np.sqrt(squares[at])
            by_t = np.array([((dl / chance)[y == k + 1].sum() - (du / chance)[y == k].sum()) / len(rows) for k in range(grades - 1)])
            by_raw = np.cumsum(by_t[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
            raw_squares += by_raw ** 2
            raw -= RATE * by_raw / np.sqrt(raw_squares)
    return Model(weights.astype(np.float32), thresholds())


def sample(docs: DataFrame, rated: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, grade) of at most about so many rated rows, drawn by doc_id; rated: (doc_id, grade)."""
    rated = rated.where("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    share = min(1.0, 0.95 * rows / max(1, rated.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))
    return docs.select("doc_id", "text").where(drawn).join(rated.where(drawn), "doc_id")


def train(docs: DataFrame, rated: DataFrame, grades: int = GRADES, rows: int = SAMPLE_ROWS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, starts = features(batch.column("text").to_pylist())
            cells = [index[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade").cast(pa.int32()), pa.array(cells, pa.binary())], ["doc_id", "grade", "cells"])

    got = sample(docs, rated, rows).mapInArrow(run, "doc_id bigint, grade int, cells binary").limit(rows).collect()
    got.sort(key=lambda r: (r.doc_id, r.cells))
    parts = [np.frombuffer(r.cells, np.int32) for r in got]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return fit(np.concatenate(parts) if parts else np.zeros(0, np.int32), starts, np.array([r.grade for r in got], np.int64), grades)


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_grade, tails): the mean grade and P(grade >= 1), P(grade >= 2), ... of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                tails = sent.value.tails(sent.value.link(*features(texts[a:b])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(tails.sum(axis=0)), pa.array(list(tails.T), pa.list_(pa.float64()))],
                                                 ["doc_id", "expected_grade", "tails"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, expected_grade double, tails array<double>")
