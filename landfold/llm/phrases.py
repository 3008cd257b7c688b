"""Phrase collocation mining over a prefix-free parse of the corpus.

Texts, A-Z lower-cased, are pieces between [.,;:!?\\x0A-\\x0D], and pieces are words [^\\x20\\x09]+. parse() cuts each
text where the hash of a window of longest - 1 words says so (one window in PERIOD, or after MOST_WORDS words), wherever
that window stands. Chunks overlap by just that window, so that every run of up to `longest` words lies in one chunk, and
it is assigned to the chunk in which it starts outside the closing window: once. Equal chunks combine before the shuffle
into the dictionary (lang, chunk, n); everything after it reads each different chunk once and weighs it by n.

* pair_sieve() counts pairs of adjacent words as 64-bit hashes, in packets by hash range; the frequent ones set bits of a
  filter of SIEVE_BYTES, whatever the corpus. Equal hashes only let more pairs through.
* counts() counts words, and those runs of 2 to `longest` words all of whose pairs pass, as texts: these counts are exact.
* collocations() scores the frequent runs by their worst cut in exact decimals, drops those inside frequent longer ones,
  and ranks the rest: the best of every salted part of a language first, so that no task holds a language.

A larger corpus should have a larger SIEVE_BYTES and PAIRS_PER_BUCKET; a full filter lets more runs be counted as texts
and changes no result. A language or a word with a third of all words is spread by chunk and by run; a run that is met
everywhere combines in each task first.

Null texts are empty and have no words; a null language is `und` and one with it. Ids are not read: repeated rows count
again. A language without words, or an empty table, gives no rows. Ties are settled by count, then phrase in UTF-8 byte
order. Further columns are not read. A very long text is parsed a piece at a time, with what follows its last cut.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landfold.llm.common import SLICE_BYTES, U64, chain, mix, pieces, run_hashes, text_or_empty
from landfold.session import cut_lineage

LONGEST, LEAST_COUNT, TOP, INSIDE_PCT = 3, 10, 2000, 50
PERIOD, MOST_WORDS = 32, 4096
SIEVE_BYTES = 16 << 20
PAIRS_PER_BUCKET = 2 << 20
LEAST_BUCKETS = 32
HELD_PAIRS, HELD_RUNS = 2 << 20, 400_000
SALTS = 64
END = b"\xff"
BREAKS = re.compile(rb"[.,;:!?\x20\x09-\x0D]")
MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[0x20, 0x0A, 0xFF]] = True


def plain(raw: bytes) -> bytes:
    """Lower-cased, with line feeds for the ends of pieces and one space between the words of a piece."""
    raw = raw.lower().translate(MARKS)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


class Stream:
    """The words of some plain texts: where they are, the number of their text, and whether the next one follows in the same piece."""

    def __init__(self, texts: list[bytes]):
        self.raw = END.join(texts) + END
        data = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate([[False], ~OUTSIDE[data]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.text = np.searchsorted(np.flatnonzero(data == 0xFF), self.starts)
        self.hash = run_hashes(data, self.starts, self.ends)
        self.follows = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.follows[:-1] = (self.ends[:-1] + 1 == self.starts[1:]) & (data[self.ends[:-1]] == 0x20)


def boundaries(words: Stream, overlap: int, period: int, most: int) -> np.ndarray:
    """Where chunks begin: at a text's first word, where the window of the next words says so, and after so many words without."""
    n = len(words.starts)
    at = np.arange(n)
    fits = np.zeros(n, bool)
    if n >= overlap:
        fits[: n - overlap + 1] = words.text[: n - overlap + 1] == words.text[overlap - 1:]
    first = np.concatenate([[True], words.text[1:] != words.text[:-1]]) if n else fits
    called = np.zeros(n, bool)
    if n >= overlap:
        called[: n - overlap + 1] = chain([words.hash[j: n - overlap + 1 + j] for j in range(overlap)]) % U64(period) == 0
    begins = at[first | (called & fits)]
    gaps = np.diff(np.append(begins, n))
    extra = [np.arange(b + most, b + gap, most) for b, gap in zip(begins[gaps > most], gaps[gaps > most])]
    if extra:
        forced = np.concatenate(extra)
        begins = np.union1d(begins, forced[fits[forced]])
    return begins


def cut(texts: list[bytes], overlap: int, period: int, most: int, ended: bool = True) -> tuple[list[tuple[int, bytes]], bytes]:
    """(number of the text, chunk) of some plain texts; a text's last chunk ends with a line feed.

    ended=False: the last chunk is not given out but returned beside, since more of the text follows.
    """
    words = Stream(texts)
    begins = boundaries(words, overlap, period, most)
    out, rest = [], b""
    if not len(begins):
        return out, rest
    text, start = words.text[begins], words.starts[begins]
    more = np.append(text[1:] == text[:-1], False)
    last = np.append(begins[1:] + overlap - 1, 0)
    final = np.searchsorted(words.text, text, side="right") - 1
    end = words.ends[np.where(more, last, final)]
    for t, a, b, inner in zip(text.tolist(), start.tolist(), end.tolist(), more.tolist()):
        if inner or ended:
            out.append((t, words.raw[a:b] + (b"" if inner else b"\n")))
        else:
            rest = words.raw[a:-1]
    return out, rest


def parse(texts: list[bytes], overlap: int = LONGEST - 1, period: int = PERIOD, most: int = MOST_WORDS, size: int = SLICE_BYTES) -> Iterator[tuple[int, bytes]]:
    """(number of the text, chunk) of each chunk, in working memory of a few times `size`."""
    numbers, held, total = [], [], 0
    for i, raw in enumerate([*texts, None]):
        if raw is not None and len(raw) <= size:
            numbers.append(i)
            held.append(plain(raw))
            total += len(raw)
        if held and (raw is None or total > size):
            for t, chunk in cut(held, overlap, period, most)[0]:
                yield numbers[t], chunk
            numbers, held, total = [], [], 0
        if raw is not None and len(raw) > size:
            rest = b""
            for piece in pieces(raw, BREAKS, size):
                found, rest = cut([plain(rest + piece)], overlap, period, most, ended=False)
                yield from ((i, chunk) for _, chunk in found)
            yield from ((i, chunk) for _, chunk in cut([rest], overlap, period, most)[0])


def dictionary(docs: DataFrame, longest: int = LONGEST, period: int = PERIOD) -> DataFrame:
    """(lang, chunk, n): each different chunk of a language's texts and how often it occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, chunks, size = [], [], 0
            of = batch.column("lang").to_pylist()
            for t, chunk in parse(batch.column("text").cast(pa.binary()).to_pylist(), longest - 1, period):
                langs.append(of[t])
                chunks.append(chunk)
                size += len(chunk)
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary())], ["lang", "chunk"])
                    langs, chunks, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary())], ["lang", "chunk"])

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "lang string, chunk binary").groupBy("lang", "chunk").agg(F.count("*").alias("n"))


class Chunks(Stream):
    """The words of some chunks with their weights, and which of them count here and not in the next chunk."""

    def __init__(self, langs: list[str], chunks: list[bytes], weights: np.ndarray, overlap: int):
        super().__init__(chunks)
        self.langs = langs
        self.weight = weights[self.text]
        sizes = np.bincount(self.text, minlength=len(chunks))
        place = np.arange(len(self.text)) - (np.cumsum(sizes) - sizes)[self.text]
        closing = np.where([c.endswith(b"\n") for c in chunks], 0, overlap)
        self.counts = place < (sizes - closing)[self.text]
        seeds = {x: int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") for x in set(langs)}
        self.salt = np.array([seeds[x] for x in langs], U64)[self.text] if len(langs) else np.zeros(0, U64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The words that have a next one in their piece, and the hashes of the two."""
        at = np.flatnonzero(self.follows)
        return at, mix(chain([self.hash[at], self.hash[at + 1]]) + self.salt[at])


def read(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[Chunks]:
    """The dictionary's rows, a few megabytes at a time."""
    for batch in batches:
        langs, chunks, weights = batch.column("lang").to_pylist(), batch.column("chunk").to_pylist(), batch.column("n").to_numpy()
        start = size = 0
        for i, chunk in enumerate(chunks):
            size += len(chunk) + 1
            if size > SLICE_BYTES or i + 1 == len(chunks):
                yield Chunks(langs[start: i + 1], chunks[start: i + 1], weights[start: i + 1], overlap)
                start, size = i + 1, 0


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def bit_of(keys: np.ndarray, buckets: int, size: int) -> np.ndarray:
    """A hash's place in the filter: its bucket's slice, and there what its low bits say."""
    each = size * 8 // buckets
    return bucket_of(keys, buckets) * each + (keys % U64(each)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are a power of two."""
    return (keys >> U64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)


def pair_sieve(words: DataFrame, buckets: int, least: int = LEAST_COUNT, longest: int = LONGEST, size: int = SIEVE_BYTES) -> np.ndarray:
    """Bits of the pairs that occur so often, and of few others: a filter of `size` bytes."""
    def packets(keys, n):
        places = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
        filled = np.flatnonzero(places[1:] > places[:-1])
        parts = [[x[places[b]: places[b + 1]].tobytes() for b in filled] for x in (keys, n)]
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]], ["bucket", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, loose = [np.zeros(0, U64), np.zeros(0, np.int64)], []
        for chunks in read(batches, longest - 1):
            at, keys = chunks.pairs()
            mine = chunks.counts[at]
            loose.append(summed(keys[mine], chunks.weight[at[mine]]))
            if sum(len(k) for k, _ in loose) > HELD_PAIRS:
                held = summed(*[np.concatenate([h, *x]) for h, x in zip(held, zip(*loose))])
                loose = []
                if len(held[0]) > 2 * HELD_PAIRS:
                    yield packets(*held)
                    held = [np.zeros(0, U64), np.zeros(0, np.int64)]
        yield packets(*summed(*[np.concatenate([h, *x]) for h, x in zip(held, zip(*loose))]) if loose else held)

    def slice_of(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", U64), ("n", np.int64))]
        keys, n = summed(*parts)
        bits = np.zeros(size * 8 // buckets, np.uint8)
        bits[bit_of(keys[n >= least], buckets, size) % len(bits)] = 1
        return pa.table({"bucket": group.column("bucket")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    sieve = np.zeros(size, np.uint8)
    slices = words.mapInArrow(run, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(slice_of, "bucket int, bits binary")
    for row in slices.toLocalIterator():  # size bytes together, whatever the corpus
        sieve[row.bucket * (size // buckets): (row.bucket + 1) * (size // buckets)] = np.frombuffer(row.bits, np.uint8)
    return sieve


def counts(words: DataFrame, sieve: np.ndarray, buckets: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n): exact counts of words, and of the runs whose pairs all pass the filter; '' counts all words."""
    sent = words.sparkSession.sparkContext.broadcast(sieve)

    def rows(tally):
        langs = [lang for lang, c in tally.items() for _ in c]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([k for c in tally.values() for k in c], pa.binary()).cast(pa.string()),
                                           pa.array([n for c in tally.values() for n in c.values()], pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = defaultdict(Counter)
        for chunks in read(batches, longest - 1):
            passed = np.zeros(len(chunks.text), bool)
            at, keys = chunks.pairs()
            bit = bit_of(keys, buckets, sent.value.size)
            passed[at] = sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            codes = {x: i for i, x in enumerate(dict.fromkeys(chunks.langs))}
            lang = np.array([codes[x] for x in chunks.langs])[chunks.text] if codes else np.zeros(0, int)
            runs = chunks.counts
            for m in range(1, longest + 1):
                if m > 1:
                    runs = runs[: len(runs) - 1] & passed[m - 2: len(passed)][: len(runs) - 1] if m > 2 else (runs & passed)[: len(runs) - 1]
                for name, code in codes.items():
                    mine = np.flatnonzero(runs & (lang[: len(runs)] == code))
                    weight = chunks.weight[mine]
                    for once in (True, False):
                        some = mine[(weight == 1) == once]
                        texts = [chunks.raw[a:b] for a, b in zip(chunks.starts[some].tolist(), chunks.ends[some + m - 1].tolist())]
                        if once:
                            tally[name].update(texts)
                        else:
                            for key, w in zip(texts, chunks.weight[some].tolist()):
                                tally[name][key] += w
                    if m == 1 and len(mine):
                        tally[name][b""] += int(weight.sum())
            if sum(map(len, tally.values())) > HELD_RUNS:
                yield rows(tally)
                tally = defaultdict(Counter)
        yield rows(tally)

    return words.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def buckets_for(words: DataFrame, period: int = PERIOD) -> int:
    """How many hash ranges hold the pairs of so many chunks; a power of two."""
    return 1 << (max(LEAST_BUCKETS, words.count() * period // PAIRS_PER_BUCKET) - 1).bit_length()


def frequent_runs(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n) of all words and runs of up to `longest` words that occur so often; '' counts all words of a language."""
    words = cut_lineage(dictionary(docs, longest))
    buckets = buckets_for(words)
    found = counts(words, pair_sieve(words, buckets, least, longest), buckets, longest)
    return cut_lineage(found.where((F.col("n") >= least) | (F.col("phrase") == "")))


def collocations(runs: DataFrame, top: int = TOP, inside_pct: int = INSIDE_PCT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best runs of two words or more."""
    spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" ")))
    found = runs.where(spaces > 0).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    m = F.size("words")

    def joined(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, m - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(runs.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    # integral division of whole decimals of 38 digits: exact for counts below 10**15
    score = F.expr("(cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0)) * cast(1000000 AS decimal(7, 0))) div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0)))")
    worst = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    size = F.explode(F.sequence(F.lit(2), m - 1))
    longer = found.where(m > 2).select("lang", "a", "words", size.alias("size"))
    longer = longer.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), m - F.col("size") + 1)).alias("at"))
    around = longer.groupBy("lang", joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    left = worst.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_pct * F.col("a")))

    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = runs.where("phrase = ''").select("lang", "n")
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT id, lang, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS piece, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT id, lang, piece, generate_subscripts(regexp_extract_all(t, '[^\x20\x09]+'), 1) AS pos, unnest(regexp_extract_all(t, '[^\x20\x09]+')) AS w FROM p),
s AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id, piece ORDER BY pos)),
f AS MATERIALIZED (SELECT lang, w1 AS phrase, 1 AS m, count(*) AS n FROM s GROUP BY ALL
    UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND n >= {LEAST_COUNT}),
k AS (SELECT *, array_to_string(words[:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest FROM c, range(1, 3) t(k) WHERE k < m),
z AS (SELECT k.lang, k.phrase, k.words, k.m, k.a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * k.a * k.a) // (x.n::HUGEINT * y.n) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, a, array_to_string(words[:2], ' ') AS phrase FROM c WHERE m = 3
    UNION ALL SELECT lang, a, array_to_string(words[2:], ' ') FROM c WHERE m = 3) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score::BIGINT AS score
    FROM b LEFT JOIN g ON g.lang = b.lang AND g.phrase = b.phrase WHERE around IS NULL OR 100 * around < {INSIDE_PCT} * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= {TOP}"""
