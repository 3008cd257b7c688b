"""Exact n-gram Jaccard join of texts by T-occurrence search, and the classes its links make.

A document's set is its distinct 5-word shingles (64-bit hashes; fewer words: one shingle of them all). Documents link
at a Jaccard similarity of 0.8 or more, so a linked document shares at least 80 % of its set with one other.

1. Support: where a document is read, its shingles in the lowest ZONE of the hash range are sent to buckets of that
   range. A document with more than 20 % of its set unshared already in the zone cannot link and is out. A shingle that
   repeats inside a block of input is sent once, so a common one costs a bucket as many entries as there are blocks.
2. Equal texts become one class; only classes left by step 1 go on, with their whole sets.
3. The classes' shingles get their document frequency and are ordered by it. The first 20 % + 1 of a set, its prefix,
   holds a shingle of any partner. Inverted lists are made of the prefixes.
4. Classes that meet in the lists, directly or by others, form a group; linked classes are always in one. All pairs of a
   group are searched in tasks of bounded size: short inverted lists are merged, candidates that can still reach the
   overlap T are probed in the L longest lists (DivideSkip), and those that reach T link. A group too large for a task is
   cut in parts: a part meets itself in one task and every other part in one more, so that each pair has one owner.
5. A task returns one row per class and not its pairs: how many documents its partners there have, and one of its
   component there. A document's links are the sum of these and the other documents of its class.

Null and empty texts and texts without words have an empty set and link with nothing. Repeated rows are copies like
others. A null doc_id is no component's id unless no member has one. An empty table gives no rows. Further columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import U64, Words, block_count, chain, slices
from landfold.plans.components import connected
from landfold.session import cut_lineage

SHINGLE, PERCENT = 5, 80
ZONE = 0.35
BLOCK_CHARS, BLOCK_DOCS = 8 << 20, 60_000
PART = 4096
SENT_IDS = 4_000_000
SHARED = np.uint16(65535)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each text its sorted set, and two hashes of its sequence of words."""
    for a, b in slices(texts):
        words = Words(texts[a:b])
        grams, at = words.grams(k)
        ends = np.searchsorted(words.text[at], np.arange(b - a + 1))
        for t in range(b - a):
            own = words.hash[words.first[t]:words.first[t + 1]]
            n = len(own)
            if 0 < n < k:
                found = chain([own[j:j + 1] for j in range(n)])
            else:
                found = np.unique(grams[ends[t]:ends[t + 1]])
            spots = np.arange(1, n + 1, dtype=U64)
            whole = [int(np.bitwise_xor.reduce(chain([own, spots * U64(salt)]), initial=U64(n))) for salt in (3, 5)]
            yield found, whole[0], whole[1]


def needed(n, percent: int = PERCENT):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def support(docs: DataFrame, percent: int = PERCENT, zone: float = ZONE) -> DataFrame:
    """(doc_id, n, c1, c2, linkable) per row: the set's size, the class of equal texts, and whether it may have a partner."""
    buckets = block_count(docs.sparkSession, docs)
    limit = U64(int(zone * 2**64))
    width = U64(int(limit) // buckets + 1)

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 24, 0
        state = {"ids": [], "n": [], "c1": [], "c2": [], "sets": [], "chars": 0}

        def flush():
            nonlocal number
            sets = state["sets"]
            token = np.concatenate(sets) if sets else np.zeros(0, U64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.uint16)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            runs = np.flatnonzero(first)
            size = np.diff(np.append(runs, len(token)))
            twice = np.repeat(size > 1, size)
            here = np.bincount(owner[twice], minlength=len(sets))
            token, owner = token[runs], np.where(size > 1, SHARED, owner[runs]).astype(np.uint16)
            cuts = np.searchsorted(token, np.arange(buckets + 1, dtype=U64) * width)
            rows = {"bucket": [], "block": [], "token": [], "owner": [], "head": []}
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    rows["bucket"].append(b)
                    rows["token"].append(token[cuts[b]:cuts[b + 1]].tobytes())
                    rows["owner"].append(owner[cuts[b]:cuts[b + 1]].tobytes())
                    rows["head"].append(None)
            rows["bucket"].append(number % buckets)
            rows["token"].append(None)
            rows["owner"].append(None)
            head = pa.RecordBatch.from_arrays([pa.array(state["ids"], pa.int64()), pa.array(state["n"], pa.int64()), pa.array(state["c1"], pa.uint64()).view(pa.int64()),
                                               pa.array(state["c2"], pa.uint64()).view(pa.int64()), pa.array(here, pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                                              ["doc_id", "n", "c1", "c2", "shared", "in_zone"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            rows["head"].append(sink.getvalue().to_pybytes())
            rows["block"] = [base + number] * len(rows["bucket"])
            number += 1
            for x in ("ids", "n", "c1", "c2", "sets"):
                state[x] = []
            state["chars"] = 0
            return pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("token", pa.binary()), ("owner", pa.binary()), ("head", pa.binary())]))

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, text, (found, c1, c2) in zip(ids, texts, shingle_sets(texts)):
                state["ids"].append(doc_id)
                state["n"].append(len(found))
                state["c1"].append(c1)
                state["c2"].append(c2)
                state["sets"].append(found[:np.searchsorted(found, limit)])
                state["chars"] += len(text or "")
                if state["chars"] >= BLOCK_CHARS or len(state["ids"]) >= BLOCK_DOCS:
                    yield flush()
        if state["ids"]:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        """Tokens of one bucket: how many of each block's entries are held elsewhere too."""
        heads = group.filter(group.column("head").is_valid())
        rows = group.filter(group.column("token").is_valid())
        token = [np.frombuffer(x, U64) for x in rows.column("token").to_pylist()]
        owner = [np.frombuffer(x, np.uint16) for x in rows.column("owner").to_pylist()]
        out = {"block": heads.column("block").to_pylist(), "owner": [None] * len(heads), "count": [None] * len(heads), "head": heads.column("head").to_pylist()}
        if token:
            every, lengths = np.concatenate(token), [len(x) for x in token]
            _, back, counts = np.unique(every, return_inverse=True, return_counts=True)
            elsewhere = counts[back] > 1
            at = 0
            for block, who, n in zip(rows.column("block").to_pylist(), owner, lengths):
                hit = who[elsewhere[at:at + n] & (who != SHARED)]
                at += n
                who, count = np.unique(hit, return_counts=True)
                if len(who):
                    out["block"].append(block)
                    out["owner"].append(who.tobytes())
                    out["count"].append(count.astype(np.uint32).tobytes())
                    out["head"].append(None)
        return pa.Table.from_pydict(out, pa.schema([("block", pa.int64()), ("owner", pa.binary()), ("count", pa.binary()), ("head", pa.binary())]))

    def sum_up(group: pa.Table) -> pa.Table:
        raw = next(x for x in group.column("head").to_pylist() if x is not None)
        head = pa.ipc.open_stream(raw).read_all()
        shared = head.column("shared").to_numpy().copy()
        for who, count in zip(group.column("owner").to_pylist(), group.column("count").to_pylist()):
            if who is not None:
                shared[np.frombuffer(who, np.uint16)] += np.frombuffer(count, np.uint32)
        n = head.column("n").to_numpy()
        unshared = head.column("in_zone").to_numpy() - shared
        may = (n > 0) & (unshared <= n - needed(n, percent))
        return head.select(["doc_id", "n", "c1", "c2"]).append_column("linkable", pa.array(may))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sent = rows.mapInArrow(zones, "bucket int, block bigint, token binary, owner binary, head binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block bigint, owner binary, count binary, head binary")
    return met.groupBy("block").applyInArrow(sum_up, "doc_id bigint, n bigint, c1 bigint, c2 bigint, linkable boolean")


def class_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, n, tokens) of classes (cid, rep, n, c1, c2); tokens: the sorted set as unsigned 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s[1] for s in sets], pa.uint64()).view(pa.int64()), pa.array([s[2] for s in sets], pa.uint64()).view(pa.int64()),
                                              pa.array([s[0].tobytes() for s in sets], pa.binary())], ["doc_id", "c1", "c2", "tokens"])

    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    small = reps.count() <= SENT_IDS
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = rows.join(F.broadcast(reps) if small else reps, rows["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi").mapInArrow(run, "doc_id bigint, c1 bigint, c2 bigint, tokens binary")
    named = classes.select("cid", "n", "c1", "c2", F.col("rep").alias("doc_id"))
    same = [found[c].eqNullSafe(named[c]) for c in ("c1", "c2", "doc_id")]
    return found.join(named, same).select("cid", "n", "tokens").dropDuplicates(["cid"])


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, cid): the rarest shingles of each set, as many as hold one of any partner; those of one class only are left out."""
    blocks = block_count(sets.sparkSession, sets)
    width = U64((1 << 64) // blocks + 1)
    blocked = cut_lineage(sets.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block", "cid"))

    def ordered(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (tokens // width).astype(np.int64)
        order = np.argsort(at, kind="stable")
        return order, np.searchsorted(at[order], np.arange(blocks + 1))

    def split(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("cid")
        tokens = np.concatenate([np.frombuffer(x, U64) for x in group.column("tokens").to_pylist()])
        order, cuts = ordered(tokens)
        full = [b for b in range(blocks) if cuts[b] < cuts[b + 1]]
        return pa.Table.from_pydict({"bucket": full, "block": [key[0].as_py()] * len(full), "token": [tokens[order[cuts[b]:cuts[b + 1]]].tobytes() for b in full]},
                                    pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("token", pa.binary())]))

    def count(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, U64) for x in group.column("token").to_pylist()]
        _, back, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        ends = np.cumsum([0, *[len(p) for p in parts]])
        df = counts[back].astype(np.uint32)
        return pa.Table.from_pydict({"block": group.column("block").to_pylist(), "bucket": [key[0].as_py()] * len(parts), "df": [df[a:b].tobytes() for a, b in zip(ends, ends[1:])]},
                                    pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("df", pa.binary())]))

    def choose(own: pa.Table, counted: pa.Table) -> pa.Table:
        own = own.sort_by("cid")
        sets_ = [np.frombuffer(x, U64) for x in own.column("tokens").to_pylist()]
        tokens = np.concatenate(sets_) if sets_ else np.zeros(0, U64)
        order, cuts = ordered(tokens)
        df = np.zeros(len(tokens), np.uint32)
        for b, raw in zip(counted.column("bucket").to_pylist(), counted.column("df").to_pylist()):
            df[order[cuts[b]:cuts[b + 1]]] = np.frombuffer(raw, np.uint32)
        token, cid, at = [], [], 0
        for key, n, s in zip(own.column("cid").to_pylist(), own.column("n").to_pylist(), sets_):
            held = df[at:at + n]
            at += n
            least = int(needed(n, percent))
            if (held > 1).sum() >= least:
                first = np.lexsort((s, held))[: n - least + 1]
                first = first[held[first] > 1]
                token.append(s[first].view(np.int64))
                cid += [key] * len(first)
        joined = np.concatenate(token) if token else np.zeros(0, np.int64)
        return pa.Table.from_pydict({"token": joined, "cid": cid}, pa.schema([("token", pa.int64()), ("cid", pa.int64())]))

    dealt = blocked.groupBy("block").applyInArrow(split, "bucket int, block int, token binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "block int, bucket int, df binary")
    return blocked.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(choose, "token bigint, cid bigint")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def partners(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i all sets j of another side that link with it; each pair comes once.

    Sets are taken by growing size, each a query against those before it. Lists hold places in that order.
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])), np.int64)
    size = np.array([len(sets[i]) for i in order])
    side = np.asarray(side)[order]
    tokens = np.concatenate([sets[i] for i in order]) if len(order) else np.zeros(0, U64)
    place = np.repeat(np.arange(len(order)), size)
    by_token = np.argsort(tokens, kind="stable")
    vocabulary, rank, width = np.unique(tokens, return_inverse=True, return_counts=True)
    starts, entries = np.cumsum(width) - width, place[by_token]
    nth = np.empty(len(tokens), np.int64)  # how many earlier sets hold the same shingle
    nth[by_token] = np.arange(len(tokens)) - np.repeat(starts, width)
    first = np.cumsum(size) - size
    for q, i in enumerate(order.tolist()):
        own = slice(first[q], first[q] + size[q])
        low, length = starts[rank[own]], nth[own]
        keep = length > 0
        low, length = low[keep], length[keep]
        least = int(needed(int(size[q]), percent))
        if len(length) < max(1, least):
            continue
        by_length = np.argsort(length, kind="stable")
        long = min(least - 1, int(least / (0.01 * np.log2(max(2, length.max())) + 1)))
        cut = len(length) - long
        short, probed = by_length[:cut], by_length[cut:]
        flat = np.repeat(low[short] - np.concatenate([[0], np.cumsum(length[short])[:-1]]), length[short]) + np.arange(length[short].sum())
        counts = np.bincount(entries[flat], minlength=q)
        smallest = np.searchsorted(size, least)
        merged = np.flatnonzero((counts >= least - long) & (np.arange(q) >= smallest) & (side[:q] != side[q]))
        counts = counts[merged]
        for left, k in enumerate(probed[::-1]):
            if not len(merged):
                break
            one = entries[low[k]:low[k] + length[k]]
            if len(one) < 16 * len(merged):
                held = np.zeros(q, bool)
                held[one] = True
                counts = counts + held[merged]
            else:
                counts = counts + (one[np.minimum(np.searchsorted(one, merged), len(one) - 1)] == merged)
            may = counts + (long - left - 1) >= least
            merged, counts = merged[may], counts[may]
        found = merged[100 * counts >= percent * (size[q] + size[merged] - counts)]
        if len(found):
            yield i, order[found]


def divide_skip(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """All links (i, j) between sets of different sides."""
    return [(i, j) for i, found in partners(sets, side, percent) for j in found.tolist()]


def cell_links(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Per set the weight of its partners, and a set of its component: the links of a cell in space linear in its sets."""
    total, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for i, found in partners(sets, side, percent):
        total[i] += weight[found].sum()
        total[found] += weight[i]
        met = np.unique(label[np.append(found, i)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return total, label


def group_links(groups: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cid, v, links) per class and cell: a class of its component (itself if it has none) and the documents it links with there; groups: (cid, component, weight)."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    bins = block_count(groups.sparkSession, groups, PART // 2, 1)
    sized = groups.join(sizes, "component").withColumn("parts", F.ceil(F.col("members") / PART).cast("int"))
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    cells = F.expr("transform(sequence(0, parts - 1), x -> struct(concat_ws('-', component, least(x, part), greatest(x, part)) as cell, x <> part as across))")
    small = F.array(F.struct(F.concat(F.lit("bin-"), F.pmod(F.xxhash64("component"), F.lit(bins))).alias("cell"), F.lit(False).alias("across")))
    placed = sized.withColumn("part", part).select("cid", "weight", "part", F.explode(F.when(F.col("parts") > 1, cells).otherwise(small)).alias("at")).select("cid", "weight", "part", "at.*")

    def search(group: pa.Table) -> pa.Table:
        cid = group.column("cid").to_numpy()
        side = group.column("part").to_numpy() if group.column("across")[0].as_py() else np.arange(len(cid))
        total, label = cell_links([np.frombuffer(x, U64) for x in group.column("tokens").to_pylist()], side, group.column("weight").to_numpy(), percent)
        return pa.Table.from_pydict({"cid": cid, "v": cid[label], "links": total}, pa.schema([("cid", pa.int64()), ("v", pa.int64()), ("links", pa.int64())]))

    return placed.join(sets.select("cid", "tokens"), "cid").groupBy("cell").applyInArrow(search, "cid bigint, v bigint, links bigint")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, c1, c2), one row per input row; c1 and c2 are equal for equal texts.

    n_links: the other rows that the row links with, those of equal text among them.
    """
    every = cut_lineage(support(docs, percent))
    classes = cut_lineage(every.where("linkable").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("weight")).withColumn("cid", F.monotonically_increasing_id()))
    sets = cut_lineage(class_sets(docs, classes))
    lists = cut_lineage(prefixes(sets, percent))
    heads = lists.groupBy("token").agg(F.min("cid").alias("head"), F.count("*").alias("held")).where("held > 1").select("token", "head")
    meets = cut_lineage(lists.join(heads, "token").select("cid", "head").distinct())
    members = meets.select(F.col("cid").alias("id")).distinct()
    groups = connected(members, meets.select(F.col("cid").alias("u"), F.col("head").alias("v"))).withColumnRenamed("id", "cid").join(classes.select("cid", "weight"), "cid")
    found = cut_lineage(group_links(cut_lineage(groups), sets, percent))
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    ids = classes.select(F.col("cid").alias("id"))
    joined = connected(ids, found.select(F.col("cid").alias("u"), "v")).join(classes.withColumnRenamed("cid", "id"), "id").join(sums.withColumnRenamed("cid", "id"), "id", "left")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    named = joined.join(least, "component").select("c1", "c2", "component_id", n_links.alias("n_links"))
    return every.join(named, ["c1", "c2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                                                          F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "c1", "c2")
