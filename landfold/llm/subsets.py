"""Filter interaction audit: what every order of some filters would remove, from one walk over their subsets.

A document is reduced where it is read to a mask of the filters that it fails, and masks combine before the shuffle: at
most 2**n cells per part, with counts of documents and of two labels. walk() then visits all subsets of filters in Gray
code order, toggling one filter at a time. Each cell keeps how many of its failing filters are active; where that number
leaves or reaches 0, the cell goes out of or comes back into the running survivors. The survivors of the 2**n states are
stored, and each step of each order is the difference of two of them.

The duplicate filter fails a document whose text some smaller doc_id has, whatever else removes either. The smallest
doc_id per text combines before the shuffle; a document is then looked up by (text, doc_id), which only it and its
repeated rows have, so a text with a third of all documents spreads over all tasks. Texts are compared by SHA-256.

Null texts are empty, and a null part is the part ''. A null doc_id is smaller or larger than none: it neither fails as
a duplicate nor makes others fail, and has no labels. Rows that repeat a doc_id are each counted and are no duplicates
of each other; they share their id's labels. A document has a label if any label row of its id says so; null labels say
nothing. An empty table has no parts and gives no rows. Further columns are not read. Words of a very long text are
taken a piece at a time, so that only its distinct words are held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import SLICE_BYTES, pieces, text_or_empty

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 200, 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SPACES = re.compile(rb"[\x20\x09-\x0D]")
MEASURED = "doc_id bigint, part string, digest binary, words bigint, distinct_words bigint, capitals bigint, code_points bigint, symbols bigint"
COUNTS = ("docs", "good", "toxic")


def word_numbers(raw: bytes, size: int = SLICE_BYTES) -> tuple[int, int]:
    """Words and distinct words."""
    total, seen = 0, set()
    for piece in pieces(raw, SPACES, size):
        words = piece.split()
        total += len(words)
        seen.update(words)
    return total, len(seen)


def measured(docs: DataFrame, part: str = "source") -> DataFrame:
    """MEASURED columns of each document."""
    fields = ["doc_id", "part", "digest", "words", "distinct_words", "capitals", "code_points", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            digests, words, distinct, capitals, symbols = [], [], [], [], []
            for raw in texts.cast(pa.binary()):
                raw = raw.as_py()
                n, d = word_numbers(raw)
                digests.append(hashlib.sha256(raw).digest())
                words.append(n)
                distinct.append(d)
                capitals.append(len(raw) - len(raw.translate(None, CAPITALS)))
                symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
            whole = [pa.array(x, pa.int64()) for x in (words, distinct, capitals)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), *whole, pc.cast(pc.utf8_length(texts), pa.int64()), pa.array(symbols, pa.int64())], fields)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, MEASURED)


def with_duplicates(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, digest, others) with duplicate: some smaller doc_id has the text. The rows are read twice."""
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first_", F.lit(True))
    told = rows.where("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left").select(*rows.columns, F.col("first_").isNull().alias("duplicate"))
    return told.unionByName(rows.where("doc_id IS NULL").withColumn("duplicate", F.lit(False)))


def failures(rows: DataFrame) -> dict[str, Column]:
    """The failure conditions of the five filters over measured rows with duplicates."""
    return {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distinct_words") < LEAST_DISTINCT_PCT * F.col("words"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS_PCT * F.col("code_points"),
        "D": F.col("symbols") > 0,
        "E": F.col("duplicate"),
    }


def mask_of(fails: dict[str, Column]) -> Column:
    """Bit i is set where the i-th filter fails."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(fails.values())), F.lit(0)).cast("int")


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic) from rows (doc_id, part, mask) and labels (doc_id, good, toxic as booleans)."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("good", "toxic")])
    counted = masked.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = masked.where("doc_id IS NOT NULL").join(marks.where("good OR toxic"), "doc_id")
    labelled = marked.groupBy("part", "mask").agg(F.lit(0).cast("long").alias("docs"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")])
    return counted.unionByName(labelled).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def walk(cell: dict[int, tuple[int, ...]], n: int) -> list[tuple[int, ...]]:
    """The survivors' counts under every set of active filters, by Gray code: state s has the filters of its bits."""
    width = len(next(iter(cell.values()), (0,)))
    running = [sum(c[j] for c in cell.values()) for j in range(width)]
    active, state = dict.fromkeys(cell, 0), 0
    survivors: list[tuple[int, ...]] = [tuple(running)] * (1 << n)
    for turn in range(1, 1 << n):
        bit = turn & -turn
        state ^= bit
        on = bool(state & bit)
        for mask, counts in cell.items():
            if mask & bit:
                before = active[mask]
                active[mask] = before + 1 if on else before - 1
                if before == 0 or active[mask] == 0:
                    for j in range(width):
                        running[j] += -counts[j] if on else counts[j]
        survivors[state] = tuple(running)
    return survivors


def steps(cell: dict[int, tuple[int, int, int]], names: str) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order."""
    n = len(names)
    alive = walk(cell, n)
    failing = [sum(c[0] for mask, c in cell.items() if mask >> i & 1) for i in range(n)]
    alone = [cell.get(1 << i, (0, 0, 0))[0] for i in range(n)]
    #: a set before the filter stands in size! * (others after)! orders
    shapley = [sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (alive[s][0] - alive[s | 1 << i][0]) for s in range(1 << n) if not s >> i & 1) for i in range(n)]
    for order in permutations(range(n)):
        name, state = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            before, after = alive[state], alive[state | 1 << i]
            state |= 1 << i
            removed = before[0] - after[0]
            yield name, step, after[0], removed, failing[i] - removed, alone[i], before[1] - after[1], before[2] - after[2], shapley[i]


AUDIT = {"part": pa.string(), "filter_order": pa.string(), "step": pa.int32(), **dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), pa.int64())}


def audit(found: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters, per part; a part's cells are 2**len(names) rows at most."""
    kinds = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint"}

    def run(group: pa.Table) -> pa.Table:
        cell = {r["mask"]: tuple(r[c] for c in COUNTS) for r in group.to_pylist()}
        rows = list(zip(*steps(cell, names)))
        part = pa.array(group.column("part").to_pylist()[:1] * len(rows[0]), pa.string())
        return pa.Table.from_arrays([part, *[pa.array(c, t) for c, t in zip(rows, list(AUDIT.values())[1:])]], list(AUDIT))

    return found.groupBy("part").applyInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in AUDIT.items()))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (len(words) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT_PCT} * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS_PCT} * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w LEFT JOIN l USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT 'ABCDE'[i] AS x, 1 << (i - 1)::INT AS bit FROM range(1, 6) t(i)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[:step - 1])::INT AS earlier FROM o, range(1, 6) t(step)),
q AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS toxic_lost
    FROM cell, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM q"""
