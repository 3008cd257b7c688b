"""Reversible line deduplication: exact reference-count tables with a sharded cuckoo filter in front.

A line's key is the line stripped of [\\x20\\x09-\\x0D] and A-Z lower-cased; keys of at least MIN_CHARS code points
count, as 128-bit hashes. The index has three tables, all partitioned by shard of the key's hash:

* holders (shard, k1, k2, doc_id): which document holds which key, each pair once;
* references (shard, k1, k2, n_docs, keeper): how many documents hold it, and the largest of them;
* filters (shard, cells): a cuckoo filter of the keys held by MIN_DOCS documents or more.

insert() and delete() bring all three up to date: counts of the keys they touch are taken anew from the holders, and
keys that cross the threshold are put into their shard's filter or taken out of it. A filter that overflows is built
again, twice as large, from the references.

clean() drops the lines of shared keys from every document but the keeper. The filters (about three bytes a shared
key) are sent to the tasks while they are below FILTER_BYTES, so that only suspect lines, and only texts that have any,
are shuffled; above that, all long lines go to the exact join. Either way the references decide.

Null and empty texts are one empty line. A null doc_id is one document, less than all others. Rows that repeat a
doc_id count once in the index and are each cleaned. An empty table gives an empty index and no rows. Further columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm.common import mix, slices
from landfold.session import cut_lineage

MIN_CHARS, MIN_DOCS = 40, 5
STRIPPED = " \t\n\x0b\x0c\r"
SHARDS = 64
FILTER_BYTES = 64 << 20
CELLS = 4
MOST_KICKS = 500
PAIR = ["k1", "k2"]
HOLDERS = "shard int, k1 bigint, k2 bigint, doc_id bigint"
REFERENCES = "shard int, k1 bigint, k2 bigint, n_docs bigint, keeper bigint"
FILTERS = "shard int, cells binary"


def long_lines(text: str | None, min_chars: int) -> tuple[int, list[int], list[bytes]]:
    """The number of lines, and numbers and digests of those that count."""
    numbers, digests = [], []
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        key = line.strip(STRIPPED)
        if len(key) >= min_chars:
            numbers.append(i)
            digests.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return len(lines), numbers, digests


def as_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def shard_of(k1: np.ndarray, shards: int) -> np.ndarray:
    return (k1.view(np.uint64) >> np.uint64(40)) % np.uint64(shards)


class Cuckoo:
    """Buckets of CELLS 16-bit fingerprints; a key is in one of two buckets, each found from the other and the fingerprint."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.mask = np.uint64(len(cells) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 4
        while buckets * CELLS * 0.8 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, CELLS), np.uint16))

    @classmethod
    def read(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, CELLS).copy())

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = ((k2.view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = k1.view(np.uint64) & self.mask
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ (mix(np.atleast_1d(prints).astype(np.uint64)) & self.mask)

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(k1, k2)
        return ((self.cells[a] == prints[:, None]) | (self.cells[b] == prints[:, None])).any(axis=1)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if there was no room: the filter is then to be built anew."""
        for one, bucket, twin in zip(*self.places(k1, k2)):
            for at in (bucket, twin):
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = one
                    break
            else:
                at = twin
                for kick in range(MOST_KICKS):
                    cell = kick % CELLS
                    one, self.cells[at, cell] = self.cells[at, cell], one
                    at = self.other(at, one)[0]
                    free = np.flatnonzero(self.cells[at] == 0)
                    if len(free):
                        self.cells[at, free[0]] = one
                        break
                else:
                    return False
        return True

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for one, bucket, twin in zip(*self.places(k1, k2)):
            for at in (bucket, twin):
                found = np.flatnonzero(self.cells[at] == one)
                if len(found):
                    self.cells[at, found[0]] = 0
                    break


def built(k1: np.ndarray, k2: np.ndarray, room: int = 1) -> Cuckoo:
    while True:
        made = Cuckoo.sized(room * max(1, len(k1)))
        if made.add(k1, k2):
            return made
        room *= 2


@dataclass(frozen=True)
class LineIndex:
    holders: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int = SHARDS
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def empty_index(spark: SparkSession, shards: int = SHARDS, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    return LineIndex(*[spark.createDataFrame([], s) for s in (HOLDERS, REFERENCES, FILTERS)], shards, min_chars, min_docs)


def holdings(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Distinct (shard, k1, k2, doc_id) of documents (doc_id, text)."""
    shards, min_chars = index.shards, index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                owners, digests = [], []
                for doc_id, text in zip(ids[a:b], texts[a:b]):
                    own = set(long_lines(text, min_chars)[2])
                    owners += [doc_id] * len(own)
                    digests += own
                k = as_keys(digests)
                k1, k2 = np.ascontiguousarray(k[:, 0]), k[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(k1, shards).astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(owners, pa.int64())],
                                                 ["shard", "k1", "k2", "doc_id"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, HOLDERS).distinct()


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("shard", *PAIR).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _refresh(index: LineIndex, holders: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over the new holders, of which only the touched keys (shard, k1, k2) changed."""
    keys = cut_lineage(touched.select("shard", *PAIR).distinct())
    fresh = cut_lineage(_counted(holders.join(keys, ["shard", *PAIR], "left_semi")))
    before = index.references.join(keys, ["shard", *PAIR], "left_semi")
    references = cut_lineage(index.references.join(keys, ["shard", *PAIR], "left_anti").unionByName(fresh))
    was, now = (F.coalesce(F.col(c) >= index.min_docs, F.lit(False)) for c in ("old_docs", "n_docs"))
    crossed = before.withColumnRenamed("n_docs", "old_docs").drop("keeper").join(fresh.drop("keeper"), ["shard", *PAIR], "full").where(was != now)
    filters = _turned(index.filters, crossed.select("shard", *PAIR, now.alias("enters")))
    return LineIndex(holders, references, _repaired(filters, references, index.min_docs), index.shards, index.min_chars, index.min_docs)


def _one_filter(shard: pa.Scalar, made: Cuckoo | None) -> pa.Table:
    cells = None if made is None else made.cells.tobytes()
    return pa.table({"shard": pa.array([shard.as_py()], pa.int32()), "cells": pa.array([cells], pa.binary())})


def _turned(filters: DataFrame, crossed: DataFrame) -> DataFrame:
    """Filters after keys have entered and left; cells are null where they did not fit."""
    def turn(key: tuple, old: pa.Table, moves: pa.Table) -> pa.Table:
        enters = moves.column("enters").to_numpy()
        k1, k2 = moves.column("k1").to_numpy(), moves.column("k2").to_numpy()
        if not len(old):
            return _one_filter(key[0], built(k1[enters], k2[enters]))
        held = Cuckoo.read(old.column("cells")[0].as_py())
        held.remove(k1[~enters], k2[~enters])
        return _one_filter(key[0], held if held.add(k1[enters], k2[enters]) else None)

    return cut_lineage(filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(turn, FILTERS))


def _repaired(filters: DataFrame, references: DataFrame, min_docs: int) -> DataFrame:
    """Filters without room are built again from the references of their shard."""
    full = filters.where("cells is null").select("shard")
    if full.isEmpty():
        return filters

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        return _one_filter(key[0], built(rows.column("k1").to_numpy(), rows.column("k2").to_numpy(), 2))

    shared = references.where(F.col("n_docs") >= min_docs).join(full, "shard", "left_semi").select("shard", *PAIR)
    return cut_lineage(filters.where("cells is not null").unionByName(shared.groupBy("shard").applyInArrow(build, FILTERS)))


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with these documents (doc_id, text) added; pairs that it has already stay once."""
    added = holdings(docs, index)
    if index.holders.isEmpty():
        holders = cut_lineage(added)
        references = cut_lineage(_counted(holders))
        crossed = references.where(F.col("n_docs") >= index.min_docs).select("shard", *PAIR, F.lit(True).alias("enters"))
        return LineIndex(holders, references, _repaired(_turned(index.filters, crossed), references, index.min_docs), index.shards, index.min_chars, index.min_docs)
    known = [index.holders[c].eqNullSafe(added[c]) for c in ("shard", *PAIR, "doc_id")]
    new = cut_lineage(added.join(index.holders, known, "left_anti"))
    return _refresh(index, cut_lineage(index.holders.unionByName(new)), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without these documents (doc_id)."""
    gone = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    same = index.holders["doc_id"].eqNullSafe(gone["doc_id"])
    touched = cut_lineage(index.holders.join(gone, same, "left_semi"))
    return _refresh(index, cut_lineage(index.holders.join(gone, same, "left_anti")), touched)


def _sent_filters(index: LineIndex, filter_bytes: int) -> dict[int, bytes] | None:
    """The filters, if they are small enough to be sent to every task."""
    size = index.filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0]
    return dict(map(tuple, index.filters.collect())) if size <= filter_bytes else None


def suspects(docs: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, doc_id, text, rest, n_lines, lines): lines has (no, k1, k2) of each line that may have to go; rest has the columns to carry."""
    sent = _sent_filters(index, filter_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(sent)
    shards, min_chars = index.shards, index.min_chars
    fields = pa.struct([("no", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if shared.value is None else {s: Cuckoo.read(raw) for s, raw in shared.value.items()}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                counts, numbers, digests, ends = [], [], [], [0]
                for text in texts[a:b]:
                    n, at, found = long_lines(text, min_chars)
                    counts.append(n)
                    numbers += at
                    digests += found
                    ends.append(len(numbers))
                k = as_keys(digests)
                k1, k2 = np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1])
                maybe = np.ones(len(k1), bool)
                if filters is not None:
                    at = shard_of(k1, shards)
                    maybe[:] = False
                    for s in np.unique(at):
                        here = np.flatnonzero(at == s)
                        if int(s) in filters:
                            maybe[here] = filters[int(s)].holds(k1[here], k2[here])
                offsets = np.concatenate([[0], np.cumsum(maybe)])[ends].astype(np.int32)
                lines = pa.StructArray.from_arrays([pa.array(np.array(numbers, np.int32)[maybe]), pa.array(k1[maybe]), pa.array(k2[maybe])], fields=list(fields))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), lines)],
                                                 [*part.schema.names, "n_lines", "lines"])

    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", rest.alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id bigint, doc_id bigint, text string, rest {kind}, n_lines bigint, lines array<struct<no: int, k1: bigint, k2: bigint>>")


def clean(docs: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, carried columns), one row per input row: text is what is left, n_lines the lines before dropping."""
    marked = suspects(docs, index, filter_bytes, carry)
    whole = marked.where("size(lines) = 0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "rest", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"))
    some = cut_lineage(marked.where("size(lines) > 0"))
    shared = index.references.where(F.col("n_docs") >= index.min_docs).select(*PAIR, "keeper")
    lines = some.select("row_id", "doc_id", F.explode("lines").alias("line")).select("row_id", "doc_id", "line.*")
    gone = lines.join(shared, PAIR).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("row_id").agg(F.collect_list("no").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                drop = set(drop or ())
                kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), *(batch.column(c) for c in ("rest", "n_lines", "n_dropped"))],
                                             ["doc_id", "text", "rest", "n_lines", "n_dropped"])

    held = some.select("row_id", "doc_id", "text", "rest", "n_lines").join(gone, "row_id", "left")
    counted = held.withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"))
    out = whole.unionByName(counted.mapInArrow(run, whole.schema))
    return out.select("doc_id", "text", "n_lines", "n_dropped", *[F.col("rest").getField(c).alias(c) for c in carry])
