"""Helpers shared by the corpus operators: table reading, byte-level words and their hashes, slices of a batch."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20
SLICE_TEXTS = 10_000


def give_back_memory() -> None:
    """Arrays of a megabyte or more go back to the system when they are freed, so that idle workers stay small.

    Sets the thresholds (fixed values: -1 trim, -3 mmap) of the C library's allocator, where it has them.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    found = ctypes.util.find_library("c")
    if found and hasattr(libc := ctypes.CDLL(found), "mallopt"):
        libc.mallopt(-1, 1 << 20)
        libc.mallopt(-3, 1 << 20)


give_back_memory()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def block_count(spark: SparkSession, df: DataFrame, rows_per_block: int = 4096, least: int = 32) -> int:
    """How many blocks hold the frame at so many rows each; grows with the input."""
    return max(least, -(-df.count() // rows_per_block))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * MULTIPLIER)


@cache
def _breaks(ascii_marks: bool) -> np.ndarray:
    """Which bytes end a word: [\\x20\\x09-\\x0D], or every ASCII byte but letters and digits."""
    ends = np.zeros(256, bool)
    ends[[0x20, *range(0x09, 0x0E)]] = True
    if ascii_marks:
        ends[[c for c in range(128) if not chr(c).isalnum()]] = True
    return ends


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
        made = []
        for p in (base, inverse):
            column = np.full(size, U64(p))
            column[0] = 1
            made.append(np.multiply.accumulate(column))
        if size > 8 * SLICE_BYTES:  # a single very long text: not kept
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes from starts to ends."""
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_byte_values()[data] * power[: len(data)])])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def pieces(raw: bytes, breaks: re.Pattern[bytes], size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about so many bytes, each but the first beginning with a break, so that no word is cut."""
    start = 0
    while len(raw) - start > size and (found := breaks.search(raw, start + size)):
        yield raw[start:found.start()]
        start = found.start()
    yield raw[start:] if start else raw


class Words:
    """The words of some texts: a 64-bit hash, the last two bytes and the text's number for each, and each text's first word.

    A word is a run of bytes other than [\\x20\\x09-\\x0D] of the UTF-8 text with A-Z lower-cased. All words of the
    slice are hashed at once: sums of byte values times powers, cut at the word ends. With ascii_marks, punctuation
    ends words too and is left out.
    """

    def __init__(self, texts: list[str | None], ascii_marks: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        starts_of_texts = np.cumsum([1, *[len(r) + 1 for r in raw]])[:-1] if raw else np.zeros(0, np.int64)
        inside = ~_breaks(ascii_marks)[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        power, inverse = _powers(len(data))
        sums = np.cumsum(_byte_values()[data] * power[: len(data)])
        self.hash = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts] + (ends - starts).astype(U64))
        self.tail = data[ends - 2].astype(np.uint16) << 8 | data[ends - 1]
        self.text = np.searchsorted(starts_of_texts, starts, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(raw) + 1))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows inside one text, and the number of the window's first word."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1:])
        return chain([self.hash[at + j] for j in range(k)]), at


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for a sequence of hashes; sequences of other lengths start elsewhere."""
    h = np.full(len(parts[0]), U64(len(parts) * int(MULTIPLIER) % (1 << 64)))
    for p in parts:
        h = mix(h * U64(0xD1342543DE82EF95) + p)
    return h


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, one text at least and SLICE_TEXTS at most, so that working memory is bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most or i + 1 - start >= SLICE_TEXTS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
