"""Consistent hashing on a ring of slots with virtual nodes and bounded loads.

The ring has 2**16 slots; a key's slot comes from its hash. Each shard owns many virtual nodes, and a slot's home is
the first virtual node at or after it, going clockwise. Only the count of rows per slot (at most 65,536 numbers,
whatever the input) reaches the driver, where loads are bounded: a shard keeps its own keys in ring order up to its
capacity, and the keys beyond it continue clockwise to the next shard with room. The plan is again a few ranges of
ranks per slot; rows are ranked by range partitions of the slot, the hash and the order columns, so a slot that one key
fills with a third of all rows is ranked by many tasks.

With slack 0 the capacities sum to the number of rows, so shard counts differ by one at most and only the overflow of
overfull shards moves from its home. With slack s a shard may hold (1 + s) times the mean.

Null keys share the slot of the hash of null. Repeated keys lie next to each other and may be split where a shard is
full. Ties are settled by the order columns; equal rows are interchangeable. An empty table gives no rows. Texts are not
looked at; columns of any name are carried.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from landfold.plans.ordered import numbered

SLOT_BITS = 16
VIRTUAL_NODES = 256

PLAN = StructType([StructField("ring_slot", IntegerType()), StructField("from_rank", LongType()), StructField("to_rank", LongType()),
                   StructField("shard", IntegerType()), StructField("start", LongType())])


def ring_homes(shards: int, vnodes: int) -> list[int]:
    """The home shard of each slot of the ring."""
    size = 1 << SLOT_BITS
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest()) % size, s) for s in range(shards) for v in range(vnodes))
    places = [p for p, _ in nodes]
    return [nodes[bisect.bisect_left(places, slot) % len(nodes)][1] for slot in range(size)]


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-(-int(total * (1 + slack)) // shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def bounded_plan(counts: dict[int, int], shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(slot, from_rank, to_rank, shard, start): which ranks of a slot go to which shard, from which place in it.

    Two walks over the slots of the ring: shards first keep their own keys, then what is over goes on clockwise.
    """
    size, homes = 1 << SLOT_BITS, ring_homes(shards, vnodes)
    room = capacities(sum(counts.values()), shards, slack)
    pieces, over = defaultdict(list), []
    for slot in sorted(counts):
        kept = min(counts[slot], room[homes[slot]])
        room[homes[slot]] -= kept
        if kept:
            pieces[slot].append((0, kept, homes[slot]))
        if kept < counts[slot]:
            over.append((slot, kept))
    #: next slot, going clockwise, whose home is another shard; full shards are jumped over as they fill
    turns = [s for s in range(size) if homes[s] != homes[s - 1]]
    for slot, rank in over:
        at = bisect.bisect_right(turns, slot)
        while rank < counts[slot]:
            shard = homes[turns[at % len(turns)]]
            taken = min(counts[slot] - rank, room[shard])
            if taken:
                room[shard] -= taken
                pieces[slot].append((rank, rank + taken, shard))
                rank += taken
            at += 1
    plan, used = [], [0] * shards
    for slot in sorted(pieces):
        for low, high, shard in pieces[slot]:
            plan.append((slot, low, high, shard, used[shard]))
            used[shard] += high - low
    return plan


def ring_shards(rows: DataFrame, key: str, shards: int, order: list[str], vnodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """The rows with shard (0 to shards-1) and slot (gapless from 0 in each shard); order: columns that settle ties in a ring slot.

    Columns of the rows that are named shard or slot are replaced.
    """
    spark = rows.sparkSession
    ranked_by = [f"o_{i}" for i in range(len(order))]
    hashed = F.xxhash64(key)
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]).alias("row"), hashed.alias("hash"), F.shiftrightunsigned(hashed, 64 - SLOT_BITS).cast("int").alias("at"),
                         *[F.col(f"`{c}`").alias(o) for c, o in zip(order, ranked_by)])
    counts = {r["at"]: r["n"] for r in placed.groupBy("at").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(bounded_plan(counts, shards, vnodes, slack) if shards > 1 else [(s, 0, n, 0, 0) for s, n in counts.items()], PLAN)
    ranked = numbered(placed, ["at"], ["hash", *ranked_by], "rank").withColumn("rank", F.col("rank") - 1)
    fits = (F.col("at") == F.col("ring_slot")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    return ranked.join(F.broadcast(plan), fits).select("row.*", "shard", (F.col("start") + F.col("rank") - F.col("from_rank")).alias("slot"))
