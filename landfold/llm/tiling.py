"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are words of letters and digits, lower-cased. The items' seeds (every run of MIN_TILE
words) are sent to the tasks in blocks of at most BLOCK_CHARS of item text, and each document is joined with them where
it is read: only parts of a document in which a seed occurs go on. There the longest common runs are found by running
Karp-Rabin hashes, marked in both texts, and searched again among the unmarked words with shorter and shorter runs,
so the tiles never overlap and their order does not matter. An item whose tiles cover LEAST_COVERAGE of its words is in
the document. Nothing is shuffled, however many documents share a passage.

Null and empty texts match nothing; items of fewer than MIN_TILE words are no evidence and are never reported. Repeated
rows are each judged. An empty table or benchmark gives no pairs. Other columns of the documents are not carried by
matches() and are kept as they are by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import MULTIPLIER, U64, Words, slices

MIN_TILE = 5
LEAST_COVERAGE = 0.5
BLOCK_CHARS = 8 << 20
FIRST_RUN = 20
FILTER_BITS = 20


def word_hashes(texts: list[str | None]) -> Words:
    return Words([(t or "").lower() for t in texts], ascii_marks=True)


class Runs:
    """Hashes of every run of some words, from running sums."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(len(words), MULTIPLIER)]))
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * self.power[:-1])])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the runs at these places, all brought to the same power."""
        return (self.sums[starts + length] - self.sums[starts]) * self.power[len(self.words) - starts]


def open_starts(marked: np.ndarray, length: int) -> np.ndarray:
    """Where a run of so many unmarked words begins."""
    if len(marked) < length:
        return np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(taken[length:] == taken[:-length])


def tiles(doc: np.ndarray, item: np.ndarray, least: int, closed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length) of the tiles; closed: words of doc that match nothing.

    The longest run that is unmarked in both texts comes first, the earliest in doc and then in item among equals.
    """
    width = max(len(doc), len(item))
    padded = [np.concatenate([x, np.zeros(width - len(x), U64)]) for x in (doc, item)]
    runs = [Runs(x) for x in padded]
    marked = [np.zeros(len(doc), bool) if closed is None else closed.copy(), np.zeros(len(item), bool)]
    found, length = [], max(least, min(FIRST_RUN, len(item)))
    while True:
        longest, matches = 0, []
        places = [open_starts(m, length) for m in marked]
        hashes = [r.of(p, length) for r, p in zip(runs, places)]
        where: dict[int, list[int]] = {}
        for p, h in zip(places[1].tolist(), hashes[1].tolist()):
            where.setdefault(h, []).append(p)
        hit = np.isin(hashes[0], hashes[1])
        for d, h in zip(places[0][hit].tolist(), hashes[0][hit].tolist()):
            for i in where[h]:
                if d and i and doc[d - 1] == item[i - 1] and not marked[0][d - 1] and not marked[1][i - 1]:
                    continue  # part of the match that begins a word earlier
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not marked[0][d + n] and not marked[1][i + n]:
                    n += 1
                if n >= length:
                    matches.append((-n, d, i))
                    longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        heapify(matches)
        while matches:
            n, d, i = heappop(matches)
            taken = marked[0][d:d - n] | marked[1][i:i - n]
            if not taken.any():
                marked[0][d:d - n] = marked[1][i:i - n] = True
                found.append((d, i, -n))
                continue
            # what longer tiles have left of a match waits for its turn
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
            for x, y in zip(edges[0::2].tolist(), edges[1::2].tolist()):
                if y - x >= length:
                    heappush(matches, (x - y, d + x, i + x))
        if length == least:
            return found
        length = max(least, length // 2)


@dataclass
class Block:
    """Some benchmark items and where their seeds are."""

    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    owners: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], least: int) -> Block:
        words = word_hashes([t for _, t in rows])
        grams, at = words.grams(least)
        owners = words.text[at]
        pairs = np.unique(np.stack([grams, owners.astype(U64)]), axis=1)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[grams >> U64(64 - FILTER_BITS)] = True
        items = [words.hash[words.first[k]:words.first[k + 1]] for k in range(len(rows))]
        return cls([i for i, _ in rows], items, pairs[0], pairs[1].astype(np.int64), maybe)


def found_in(texts: list[str | None], block: Block, least: int, coverage: float) -> Iterator[tuple[int, int, int, int, list]]:
    """(number of the text, number of the item, covered words, item words, tiles with places in the text) for each pair that reaches the coverage."""
    for a, b in slices(texts):
        words = word_hashes(texts[a:b])
        grams, at = words.grams(least)
        near = np.flatnonzero(block.maybe[grams >> U64(64 - FILTER_BITS)])
        low, high = (np.searchsorted(block.seeds, grams[near], side) for side in ("left", "right"))
        near, low, high = (x[high > low] for x in (near, low, high))
        hits: dict[tuple[int, int], list[int]] = {}
        for place, x, y in zip(at[near].tolist(), low.tolist(), high.tolist()):
            for owner in block.owners[x:y].tolist():
                hits.setdefault((int(words.text[place]), owner), []).append(place)
        for (text, owner), places in sorted(hits.items()):
            item = block.items[owner]
            inside = np.unique(np.concatenate([np.array(places) + j for j in range(least)]))
            breaks = np.flatnonzero(np.diff(inside) > 1) + 1
            doc, closed = np.insert(words.hash[inside], breaks, U64(0)), np.insert(np.zeros(len(inside), bool), breaks, True)
            origin = np.insert(inside, breaks, 0) - int(words.first[text])
            got = tiles(doc, item, least, closed)
            covered = sum(n for _, _, n in got)
            if covered >= coverage * len(item):
                yield a + text, owner, covered, len(item), [(int(origin[d]), i, n) for d, i, n in sorted(got)]


def blocks(benchmark: DataFrame, least: int, block_chars: int = BLOCK_CHARS) -> Iterator:
    """The items block by block, each of bounded size, as broadcasts."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-total // block_chars)
    for k in range(n):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Block.of(rows, least))


MATCHES = "item_id bigint, covered bigint, item_words bigint, coverage double, tiles array<struct<doc_word: int, item_word: int, words: int>>"


def matches(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, MATCHES columns) for each document and item that it contains."""
    fields = pa.schema([("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64()),
                        ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])))])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], f"doc_id bigint, {MATCHES}")
    for block in blocks(benchmark, least):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [{"doc_id": ids[t], "item_id": block.value.ids[o], "covered": c, "item_words": n, "coverage": c / n,
                          "tiles": [{"doc_word": d, "item_word": i, "words": w} for d, i, w in got]}
                         for t, o, c, n, got in found_in(batch.column("text").to_pylist(), block.value, least, coverage)]
                yield pa.RecordBatch.from_pylist(found, pa.schema([("doc_id", pa.int64()), *fields]))

        out = out.unionByName(rows.mapInArrow(run, f"doc_id bigint, {MATCHES}"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = LEAST_COVERAGE) -> DataFrame:
    """The documents that contain no item, with their columns."""
    for block in blocks(benchmark, least):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in found_in(batch.column("text").to_pylist(), block.value, least, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
