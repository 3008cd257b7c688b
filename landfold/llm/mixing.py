"""Mixing sources to target weights: repetition rates from token totals, then whole copies and one hash-seeded draw.

source_rates() adds the sizes up per source and shares `share` times all of them out by weight. Sources in code point
order, null last, take the weights in turn. A target stops at `most` times its source's size and the excess goes to the
others by weight until none is above: sorted by cap over weight, the sources that are cut are a prefix, and the level of
the rest is the largest of (what is left) / (weights left) along that order. Both orders are range-partitioned
(plans/ordered), so no task holds all sources. A source's rate is its target over its size.

A document comes floor(rate) times, and once more if its draw, a number in [0, 1) from the hash of the seed, its doc_id
and its text, is below the rate's fraction. Nothing else enters the decision: it is the same in every run and on every
machine, and is taken where the row is read. A source's taken words have its target as their mean and a variance of
fraction * (1 - fraction) times the sum of the squared sizes. No document comes more than ceil(most) times.

Null texts have size 0 and come like other documents of their source. A null source is a source of its own, another one
than ''. A source of size 0 has target and rate 0. Null ids are told apart by their texts; rows that repeat both id and
text are one document and share its draw. An empty table gives no sources and no rows. Further columns, whatever their
names, are carried by mix() and not read by the rest. Texts are counted by string functions whose memory is a small
multiple of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.plans import ordered
from landfold.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2.0, "mix"
#: rates of so many sources are sent to every task, a few MB; more are joined by a salted shuffle
SENT_SOURCES, SALTS = 50_000, 64
DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text: each becomes one mark, then everything else goes."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, draw) of each document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, weight, source_size, target, rate) from rows with source and size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turns = ordered.numbered(totals, [], [F.col("source").asc_nulls_last()], "turn")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    caps = turns.select("source", weight.alias("weight"), "source_size", cap.alias("cap"), (cap / weight).alias("fills_at"))
    along = cut_lineage(ordered.running(caps, [], ["fills_at", "source"], {"cut": ("sum", "cap"), "served": ("sum", "weight")}, exclusive=True))
    whole = along.agg((F.lit(float(share)) * F.sum("source_size")).alias("budget"), F.sum("weight").alias("weights"))
    left = (F.col("budget") - F.coalesce("cut", F.lit(0.0))) / (F.col("weights") - F.coalesce("served", F.lit(0)))
    level = along.crossJoin(F.broadcast(whole)).agg(F.max(left).alias("level"))  # one row
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    out = along.crossJoin(F.broadcast(level)).select("source", "weight", "source_size", target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def copies(rate: Column, drawn: Column) -> Column:
    """How often a document comes."""
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def rated(rows: DataFrame, rates: DataFrame, sent: int = SENT_SOURCES) -> DataFrame:
    """Rows with source and draw, and the columns of their source's rates; no source's rows meet in one task."""
    rates = cut_lineage(rates.select(F.col("source").alias("source_"), *[c for c in rates.columns if c != "source"]))
    same = rows["source"].eqNullSafe(rates["source_"])
    if rates.count() <= sent:
        return rows.join(F.broadcast(rates), same).drop("source_")
    salted = rates.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt_", F.floor(F.col("draw") * SALTS).cast("int"))
    joined = dealt.join(salted, dealt["source"].eqNullSafe(salted["source_"]) & (dealt["salt_"] == salted["salt_"]))
    return joined.drop("source_", "salt_")


def mix(docs: DataFrame, rates: DataFrame, seed: str = SEED, sent: int = SENT_SOURCES) -> DataFrame:
    """The rows of the mix: each document with its columns, as often as it comes."""
    packed = docs.select("source", draw(F.col("doc_id"), F.col("text"), seed).alias("draw"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    times = copies(F.col("rate"), F.col("draw")).cast("int")
    return rated(packed, rates.select("source", "rate"), sent).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of each document under the rates of the whole table."""
    rows = cut_lineage(sized(docs))
    out = rated(rows, source_rates(rows)).withColumn("copies", copies(F.col("rate"), F.col("draw")))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {DRAW_DIGITS}))::BIGINT::DOUBLE / {16**DRAW_DIGITS}.0::DOUBLE AS draw FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM docs GROUP BY source),
caps AS (SELECT *, {MOST}::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY {MOST}::DOUBLE * source_size / weight, source NULLS FIRST) AS place FROM totals),
along AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS left_over FROM caps),
rates AS (SELECT source, source_size, least(cap, max(left_over) OVER () * weight) AS target FROM along),
rated AS (SELECT doc_id, size, draw, r.source_size, target, CASE WHEN r.source_size > 0 THEN target / r.source_size ELSE 0 END AS rate FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM rated"""
