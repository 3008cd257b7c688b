"""Katz backoff language model: Good-Turing discounted bigrams over unigrams over one unknown word.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as 64-bit hashes, then one end. The first token's context is
the start of the text. With n_r the number of bigrams (words) seen r times, counts up to K are multiplied by Katz's
factor d_r; larger ones lose ABOVE, so that every context leaves some mass. Where a factor is not between 0 and 1, the
count loses ABOVE instead. What a context leaves goes to the words not seen after it in proportion to their unigram
probability: its weight is (1 - sum of its discounted bigrams) / (1 - sum of the unigrams of the words seen after it),
so all probabilities of a context sum to 1. What the words leave is the unknown word's.

The work is one job of three shuffles, and nothing passes through the driver:

1. Blocks of texts are reduced to their distinct bigrams with the texts that hold them, and dealt by the second word.
2. A bucket of second words has the whole counts of its words and bigrams. It adds up, per text, all that depends on
   them; for each context, how many words of which count follow it; and for each bigram not seen in training, a
   question for the weight of its context. Contexts and questions are dealt by context.
3. A bucket of contexts has the whole table of weights of its contexts, answers the questions and adds the answers up
   per text. Every bucket gets the counts of counts of every other, a few numbers each.
4. Sums are dealt by block of texts and give one row per text.

All sums over contexts are kept as integer counts until the discounts are known. Tables of counts and weights are thus
partitioned by word and by context; model() returns them.

A null or empty text is one end token. Rows are learnt from where the column learn is true (null: not). Repeated rows
count each. Without any row to learn from, every token has probability 1. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import SLICE_TEXTS, U64, Words, block_count, slices

K, ABOVE = 5, 0.5
START, END = U64(0x5354415254), U64(0x454E44)
BLOCK_CHARS, BLOCK_DOCS = 8 << 20, 30_000
LEARNT = np.uint16(1 << 15)
DOCS_PER_BUCKET = 8192
#: columns of a text's sums
SUMS = ("base", "logs", "known", *[f"seen{r}" for r in range(1, K + 1)], *[f"back{c}" for c in range(K + 2)])
CONTEXT = (*[f"m{r}" for r in range(1, K + 1)], "m_above", "s_above", *[f"q{c}" for c in range(1, K + 1)], "q_above", "t_above")
WIRE = pa.schema([("to", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), ("data", pa.binary())])
WIRE_SQL = "to bigint, kind string, block bigint, data binary"
SCORES = "doc_id bigint, learnt boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def packed(*parts) -> bytes:
    return pickle.dumps(parts, protocol=5)


def squeezed(*parts) -> bytes:
    return zlib.compress(pickle.dumps(parts, protocol=5), 1)


def unsqueezed(raw: bytes):
    return pickle.loads(zlib.decompress(raw))


def smallest(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Discounted counts r* for r = 0..K from n_0..n_{K+1} (n_0 unused)."""
    n = of_counts.astype(float)
    out = np.zeros(K + 1)
    top = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else 0.0
        out[r] = d * r if 0 < d < 1 else r - ABOVE
    return out


class Totals:
    """What the discounts need: counts of counts of bigrams and words, and how much was learnt from."""

    def __init__(self, parts: list[np.ndarray]):
        total = np.sum(parts, axis=0) if parts else np.zeros(2 * (K + 3) + 2, np.int64)
        self.pairs, self.words = total[: K + 3], total[K + 3: 2 * (K + 3)]
        self.tokens, self.texts = int(total[-2]), int(total[-1])
        self.vocabulary = int(self.words[1:].sum())
        self.pair_count, self.word_count = discounts(self.pairs), discounts(self.words)
        lost = sum(self.words[r] * (r - self.word_count[r]) for r in range(1, K + 1)) + ABOVE * self.words[K + 2] + ABOVE * self.words[K + 1]
        self.unknown = lost / self.tokens if self.tokens else 1.0


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    """n_0..n_{K+1}, and at K+2 how many are above that."""
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3).astype(np.int64)


def _blocks(buckets: int, width: U64):
    """Step 1: texts to rows for buckets of second words, and one row of ids for the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 24, 0
        ids, learn, lengths, first, second, chars = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, learn, lengths, first, second, chars, number
            block, flags = base + number, np.array(learn, bool)
            number += 1
            w1, w2 = np.concatenate(first), np.concatenate(second)
            text = np.repeat(np.arange(len(ids)), lengths).astype(np.uint16)
            text = np.where(flags[text], text | LEARNT, text).astype(np.uint16)
            order = np.lexsort((w1, w2))
            w1, w2, text = w1[order], w2[order], text[order]
            new = np.ones(len(w1), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            starts = np.flatnonzero(new)
            cuts = np.searchsorted(w2, np.arange(buckets + 1, dtype=U64) * width)
            cuts[-1] = len(w2)
            rows = {"to": [], "kind": [], "block": [], "data": []}
            for b in range(buckets):
                low, high = cuts[b], cuts[b + 1]
                if low < high:
                    at = starts[np.searchsorted(starts, low):np.searchsorted(starts, high)]
                    held = np.diff(np.append(at, high))
                    words, n = np.unique(w2[at], return_counts=True)
                    contexts, which = np.unique(w1[at], return_inverse=True)
                    rows["to"].append(b)
                    rows["kind"].append("pairs")
                    rows["data"].append(packed(words, contexts, smallest(which), text[low:high], squeezed(smallest(n), smallest(held))))
            rows["to"].append(block % buckets)
            rows["kind"].append("texts")
            rows["data"].append(squeezed(ids, flags, np.array(lengths)))
            rows["block"] = [block] * len(rows["to"])
            ids, learn, lengths, first, second, chars = [], [], [], [], [], 0
            return pa.RecordBatch.from_pydict(rows, WIRE)

        for batch in batches:
            all_ids, texts, flags = (batch.column(c).to_pylist() for c in ("doc_id", "text", "learn"))
            for a, b in slices(texts):
                words = Words(texts[a:b])
                tokens = np.insert(words.hash, words.first[1:], END)
                size = np.diff(words.first) + 1
                context = np.roll(tokens, 1)
                context[np.cumsum(size) - size] = START
                first.append(context)
                second.append(tokens)
                lengths += size.tolist()
                ids += all_ids[a:b]
                learn += flags[a:b]
                chars += sum(len(t or "") for t in texts[a:b])
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS - SLICE_TEXTS:
                    yield flush()
        if ids:
            yield flush()

    return run


def _count(buckets: int, width: U64):
    """Step 2: a bucket of second words."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        me = key[0].as_py()
        out = {"to": [], "kind": [], "block": [], "data": []}

        def put(to, kind, block, data):
            for c, v in zip(("to", "kind", "block", "data"), (to, kind, block, data)):
                out[c].append(v)

        w1, w2, counts, postings, owners, learnt_texts = [], [], [], [], [], 0
        for kind, block, data in zip(group.column("kind"), group.column("block"), group.column("data")):
            raw = data.as_py()
            if kind.as_py() == "texts":
                put(me, "texts", block.as_py(), raw)
                learnt_texts += int(unsqueezed(raw)[1].sum())
                continue
            words, contexts, which, text, small = pickle.loads(raw)
            n, have = unsqueezed(small)
            w1.append(contexts[which])
            w2.append(np.repeat(words, n))
            row_of = np.repeat(np.arange(len(have), dtype=np.int32), have)
            counts.append(np.bincount(row_of[(text & LEARNT) > 0], minlength=len(have)).astype(np.int32))
            postings.append((have, text))
            owners.append(block.as_py())
        numbers = np.zeros(2 * (K + 3) + 2, np.int64)
        numbers[-1] = learnt_texts
        if owners:
            ends = np.cumsum([0, *map(len, w1)])
            first, second, here = np.concatenate(w1), np.concatenate(w2), np.concatenate(counts)
            del w1, w2, counts
            order = np.lexsort((first, second))
            a, b = first[order], second[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            p1, p2 = a[new], b[new]
            del a, b
            pair = np.empty(len(first), np.int32)
            pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
            del order, new
            r = np.bincount(pair, weights=here).astype(np.int64)
            word_new = np.ones(len(p2), bool)
            word_new[1:] = p2[1:] != p2[:-1]
            word = np.cumsum(word_new) - 1
            c_of_word = np.bincount(word, weights=r).astype(np.int64)
            c = c_of_word[word]
            del p2, word, word_new, here
            numbers[: K + 3], numbers[K + 3: 2 * (K + 3)], numbers[-2] = counts_of_counts(r), counts_of_counts(c_of_word), c_of_word.sum()
            numbers[0] = numbers[K + 3] = 0
            asked = []
            for k, (block, (have, text)) in enumerate(zip(owners, postings)):
                row_of = np.repeat(np.arange(ends[k], ends[k + 1]), have)
                rp, cp, is_end = r[pair[row_of]], c[pair[row_of]], second[row_of] == END
                logs = np.where(rp > K, np.log10(np.maximum(rp - ABOVE, ABOVE)), 0.0) + np.where((rp == 0) & (cp > K), np.log10(np.maximum(cp - ABOVE, ABOVE)), 0.0)
                logs -= np.where(~is_end & (cp > 0), np.log10(np.maximum(cp, 1)), 0.0)
                own, back = np.unique(text & ~LEARNT, return_inverse=True)
                cells = [np.bincount(back, weights=x, minlength=len(own)) for x in (np.log10(cp + 1), logs)]
                level = np.minimum(cp, K + 1)
                whole = [np.bincount(back[cp > 0], minlength=len(own))]
                whole += [np.bincount(back[rp == x], minlength=len(own)) for x in range(1, K + 1)]
                whole += [np.bincount(back[(rp == 0) & (level == x)], minlength=len(own)) for x in range(K + 2)]
                put(block % buckets, "sums", block, packed(cells, squeezed(smallest(own), [smallest(x) for x in whole])))
                unseen = rp == 0
                asked.append((first[row_of[unseen]], (text & ~LEARNT)[unseen]))
            del postings, first, second, pair
            # contexts
            seen = r > 0
            contexts, which = np.unique(p1[seen], return_inverse=True)
            rs, cs, k = r[seen], c[seen], len(contexts)
            columns = [np.bincount(which[rs == x], minlength=k) for x in range(1, K + 1)] + [np.bincount(which[rs > K], minlength=k), np.bincount(which[rs > K], weights=rs[rs > K], minlength=k).astype(np.int64)]
            columns += [np.bincount(which[cs == x], minlength=k) for x in range(1, K + 1)] + [np.bincount(which[cs > K], minlength=k), np.bincount(which[cs > K], weights=cs[cs > K], minlength=k).astype(np.int64)]
            cuts = np.searchsorted(contexts, np.arange(buckets + 1, dtype=U64) * width)
            cuts[-1] = k
            for to in range(buckets):
                low, high = cuts[to], cuts[to + 1]
                if low < high:
                    put(to, "contexts", None, packed(contexts[low:high], squeezed([smallest(x[low:high]) for x in columns])))
            # questions
            ask, who = np.concatenate([x for x, _ in asked]), np.concatenate([x for _, x in asked])
            block_of = np.repeat(np.arange(len(owners)), [len(x) for x, _ in asked])
            order = np.argsort(ask, kind="stable")
            ask, block_of, who = ask[order], block_of[order], who[order]
            cuts = np.searchsorted(ask, np.arange(buckets + 1, dtype=U64) * width)
            cuts[-1] = len(ask)
            for to in range(buckets):
                low, high = cuts[to], cuts[to + 1]
                if low < high:
                    words, n = np.unique(ask[low:high], return_counts=True)
                    put(to, "questions", None, packed(owners, words, squeezed(smallest(n), smallest(block_of[low:high])), who[low:high]))
        for to in range(buckets):
            put(to, "numbers", None, numbers.tobytes())
        return pa.Table.from_pydict(out, WIRE)

    return run


def _weights(totals: Totals, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and backoff weight of each context; columns: CONTEXT."""
    m, q = columns[: K + 2], columns[K + 2:]
    r = np.arange(1, K + 1)
    count = (r[:, None] * m[:K]).sum(axis=0) + m[K + 1]
    seen = (totals.pair_count[1:, None] * m[:K]).sum(axis=0) + m[K + 1] - ABOVE * m[K]
    lower = (totals.word_count[1:, None] * q[:K]).sum(axis=0) + q[K + 1] - ABOVE * q[K]
    return count, (1 - seen / count) / (1 - lower / totals.tokens)


def _contexts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, U64), np.zeros((len(CONTEXT), 0))
    read = [pickle.loads(x) for x in parts]
    names, which = np.unique(np.concatenate([x[0] for x in read]), return_inverse=True)
    columns = [unsqueezed(x[1])[0] for x in read]
    return names, np.stack([np.bincount(which, weights=np.concatenate([c[j] for c in columns]), minlength=len(names)) for j in range(len(CONTEXT))])


def _answer(key: tuple, group: pa.Table) -> pa.Table:
    """Step 3: a bucket of contexts."""
    kinds, blocks, data = (group.column(c).to_pylist() for c in ("kind", "block", "data"))
    numbers = [np.frombuffer(x, np.int64) for k, x in zip(kinds, data) if k == "numbers"]
    totals = Totals(numbers)
    names, columns = _contexts([x for k, x in zip(kinds, data) if k == "contexts"])
    count, weight = _weights(totals, columns)
    value = np.log10(weight) + np.log10(count)
    summed: dict[int, list] = {}
    out = {"to": [], "kind": [], "block": [], "data": []}

    def put(kind, block, raw):
        for c, v in zip(("to", "kind", "block", "data"), (block, kind, block, raw)):
            out[c].append(v)

    for kind, block, raw in zip(kinds, blocks, data):
        if kind in ("sums", "texts"):
            put(kind, block, raw)
            if kind == "texts":
                put("numbers", block, np.sum(numbers, axis=0).tobytes())
        elif kind == "questions":
            owners, words, small, who = pickle.loads(raw)
            n, block_of = unsqueezed(small)
            at = np.minimum(np.searchsorted(names, words), max(0, len(names) - 1))
            known = names[at] == words if len(names) else np.zeros(len(words), bool)
            got = np.repeat(np.where(known, value[at] if len(names) else 0.0, 0.0), n)
            for k in np.unique(block_of):
                mine = block_of == k
                summed.setdefault(owners[k], []).append((who[mine], got[mine]))
    for block, parts in summed.items():
        who, back = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        put("answers", block, packed(who, np.bincount(back, weights=np.concatenate([g for _, g in parts]))))
    return pa.Table.from_pydict(out, WIRE)


def _score(key: tuple, group: pa.Table) -> pa.Table:
    """Step 4: the texts of one block."""
    kinds, data = (group.column(c).to_pylist() for c in ("kind", "data"))
    totals = Totals([np.frombuffer(next(x for k, x in zip(kinds, data) if k == "numbers"), np.int64)])
    ids, learnt, lengths = unsqueezed(next(x for k, x in zip(kinds, data) if k == "texts"))
    sums, answers = np.zeros((len(SUMS), len(ids))), np.zeros(len(ids))
    for kind, raw in zip(kinds, data):
        if kind == "sums":
            cells, small = pickle.loads(raw)
            own, whole = unsqueezed(small)
            for j, x in enumerate([*cells, *whole]):
                sums[j, own] += x
        elif kind == "answers":
            who, got = pickle.loads(raw)
            answers[who] += got
    base, logs, known, seen, back = sums[0], sums[1], sums[2], sums[3:3 + K], sums[3 + K:]
    tokens = totals.tokens
    score = logs + answers + (seen * np.log10(totals.pair_count[1:])[:, None]).sum(axis=0)
    if tokens:
        score += (back[1:K + 1] * np.log10(totals.word_count[1:] / tokens)[:, None]).sum(axis=0) - back[K + 1] * np.log10(tokens)
        score += back[0] * np.log10(totals.unknown) - np.log10(totals.texts)
    base = base - lengths * np.log10(tokens + totals.vocabulary + 1)
    return pa.Table.from_pydict({"doc_id": ids, "learnt": learnt, "n_tokens": lengths, "n_known": known.astype(np.int64), "train_tokens": [tokens] * len(ids), "base_score": base, "score": score},
                                pa.schema([("doc_id", pa.int64()), ("learnt", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))


def _counted(docs: DataFrame) -> tuple[DataFrame, int]:
    buckets = block_count(docs.sparkSession, docs, DOCS_PER_BUCKET)
    width = U64((1 << 64) // buckets + 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    sent = rows.mapInArrow(_blocks(buckets, width), WIRE_SQL)
    return sent.groupBy("to").applyInArrow(_count(buckets, width), WIRE_SQL), buckets


def score(docs: DataFrame) -> DataFrame:
    """(SCORES) one row per row of docs (doc_id, text, learn), by the model of the rows to learn from."""
    counted, _ = _counted(docs)
    return counted.groupBy("to").applyInArrow(_answer, WIRE_SQL).groupBy("to").applyInArrow(_score, SCORES)


def model(docs: DataFrame) -> DataFrame:
    """(context, n, backoff): the hash of each context, its count and its backoff weight, partitioned by context."""
    def table(key: tuple, group: pa.Table) -> pa.Table:
        kinds, data = (group.column(c).to_pylist() for c in ("kind", "data"))
        totals = Totals([np.frombuffer(x, np.int64) for k, x in zip(kinds, data) if k == "numbers"])
        names, columns = _contexts([x for k, x in zip(kinds, data) if k == "contexts"])
        count, weight = _weights(totals, columns)
        return pa.Table.from_pydict({"context": names.view(np.int64), "n": count.astype(np.int64), "backoff": weight}, pa.schema([("context", pa.int64()), ("n", pa.int64()), ("backoff", pa.float64())]))

    return _counted(docs)[0].groupBy("to").applyInArrow(table, "context bigint, n bigint, backoff double")
