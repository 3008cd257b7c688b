"""Byte-level BPE encoding and decoding of whole texts by a public rank file.

Short texts are encoded where they are read. A long text is cut into overlapping chunks that are dealt over the
cluster and pre-tokenised independently. Wherever both neighbours of an overlap agree on a pre-token boundary that no
start of tokenising could have moved (a letter or digit before it, none after it), the text is cut; the pieces
between such cuts are dealt out again, encoded, and put in order. An overlap without such a boundary joins its two
chunks to one piece, so a run without any break stays whole and the ids are those of the undivided text. Decoding
concatenates the raw bytes of the ids.

Null texts count as empty; an empty text has one piece without ids. Repeated rows stay separate rows. Other columns
of the input are not carried along.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from landfold.llm.common import slices, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Boundaries so near the end of a chunk may depend on what follows it.
MARGIN_CHARS = 8

_ENCODINGS: dict = {}


class Codec:
    """A rank file and a pattern, read once on the driver and sent to the tasks (under 1 MB for 50,000 ranks)."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        with open(vocabulary, "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern
        self.name = hashlib.sha256(self.ranks + pattern.encode()).hexdigest()

    def encoding(self):
        """The tokenizer, built once in each worker process."""
        if self.name not in _ENCODINGS:
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.ranks.splitlines())}
            _ENCODINGS[self.name] = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _ENCODINGS[self.name]

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding().encode_ordinary(text), "<u4")

    def text_bytes(self, ids: bytes) -> bytes:
        return self.encoding().decode_bytes(np.frombuffer(ids, "<u4").tolist())


def certain_boundaries(text: str, codec: Codec) -> list[int]:
    """Ends of pre-tokens that hold wherever tokenising started: after a letter or digit, before an ASCII other."""
    import regex

    pattern = regex.compile(codec.pattern)
    ends = (m.end() for m in pattern.finditer(text))
    return [e for e in ends if e < len(text) and text[e - 1].isalnum() and text[e] < "\x80" and not text[e].isalnum()]


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(row_id, id_col, piece, ids): the ids of each piece as little-endian unsigned 32-bit integers, pieces in order."""
    return encode_short(docs, codec, id_col, text_col, chunk_chars + overlap).unionByName(
        encode_long(docs, codec, id_col, text_col, chunk_chars, overlap))


def decode(pieces: DataFrame, codec: Codec) -> DataFrame:
    """The pieces with the column bytes: what their ids stand for."""
    schema = StructType([*pieces.schema, StructField("bytes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            raw = pa.array([codec.text_bytes(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, "bytes"])

    return pieces.mapInArrow(run, schema)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col), text_or_empty(text_col).alias("text"))


def encode_short(docs: DataFrame, codec: Codec, id_col: str, text_col: str, most_chars: int) -> DataFrame:
    """Texts of one chunk, encoded where they are read."""
    rows = _rows(docs, id_col, text_col).where(F.length("text") <= most_chars)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = pa.array([codec.ids(t).tobytes() for t in texts[a:b]], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column(id_col), pa.array([0] * (b - a), pa.int32()), ids],
                                                 ["row_id", id_col, "piece", "ids"])

    return rows.mapInArrow(run, f"row_id bigint, `{id_col}` {kind}, piece int, ids binary")


def encode_long(docs: DataFrame, codec: Codec, id_col: str, text_col: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Texts of several chunks: cut, pre-tokenise, stitch, encode."""
    rows = _rows(docs, id_col, text_col).where(F.length("text") > chunk_chars + overlap)
    kind = rows.schema[id_col].dataType
    typed = f"row_id bigint, `{id_col}` {kind.simpleString()}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                starts = range(0, max(1, len(text) - overlap), chunk_chars)
                for k, at in enumerate(starts):
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays(
                        [one.column("row_id"), one.column(id_col), pa.array([k], pa.int32()), pa.array([k == len(starts) - 1]),
                         pa.array([text[at:at + chunk_chars + overlap]])], ["row_id", id_col, "chunk", "last", "text"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries in the two overlaps: head as offsets in this chunk, tail as offsets in the next one."""
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                found = certain_boundaries(text, codec)
                heads.append([e for e in found if e < overlap])
                tails.append([e - chunk_chars for e in found if chunk_chars < e < len(text) - MARGIN_CHARS])
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kinds), pa.array(tails, kinds)],
                                             [*batch.schema.names, "head", "tail"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks arrive in order; text since the last cut is held until the next one."""
        held, tail, piece = "", set(), 0
        for batch in batches:
            for i, (chunk, last, text, head, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "last", "text", "head", "tail")))):
                def out(content):
                    one = batch.slice(i, 1)
                    return pa.RecordBatch.from_arrays([one.column("row_id"), one.column(id_col), pa.array([piece], pa.int32()), pa.array([content])],
                                                      ["row_id", id_col, "piece", "text"])

                if chunk == 0:
                    held, piece = text, 0
                elif common := tail.intersection(head):
                    at = min(common)
                    yield out(held[: len(held) - overlap + at])
                    held, piece = text[at:], piece + 1
                else:
                    held += text[overlap:]
                tail = set(ends)
                if last:
                    yield out(held)
                    held = ""

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([codec.ids(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], ["row_id", id_col, "piece", "ids"])

    chunks = rows.mapInArrow(cut, f"{typed}, chunk int, last boolean, text string").repartition("row_id", "chunk")
    marked = chunks.mapInArrow(pretokenise, f"{typed}, chunk int, last boolean, text string, head array<int>, tail array<int>")
    pieces = marked.repartition("row_id").sortWithinPartitions("row_id", "chunk").mapInArrow(stitch, f"{typed}, piece int, text string")
    return pieces.repartition("row_id", "piece").mapInArrow(encode_pieces, f"{typed}, piece int, ids binary")


def digests(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text",
            chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded text."""
    rows = _rows(docs, id_col, text_col).where(F.length("text") <= chunk_chars + overlap)
    pieces = encode_long(docs, codec, id_col, text_col, chunk_chars, overlap)
    parts = pieces.repartition("row_id").sortWithinPartitions("row_id", "piece")
    kind = docs.schema[id_col].dataType.simpleString()

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one chunk: encoded and decoded in the same task, where only the digests leave it."""
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                counts, digests = [], ([], [])
                for text in texts[a:b]:
                    ids = codec.ids(text).tobytes()
                    counts.append(len(ids) // 4)
                    digests[0].append(hashlib.sha256(ids).hexdigest())
                    digests[1].append(hashlib.sha256(codec.text_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(digests[0]), pa.array(digests[1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests over the pieces of a row in order; none of them is held."""
        now = None

        def out():
            row, key, n, a, b = now
            return pa.RecordBatch.from_arrays([key, pa.array([n], pa.int64()), pa.array([a.hexdigest()]), pa.array([b.hexdigest()])], names)

        for batch in batches:
            for i, (row, ids) in enumerate(zip(batch.column("row_id").to_pylist(), batch.column("ids").to_pylist())):
                if now is None or now[0] != row:
                    if now:
                        yield out()
                    now = [row, batch.slice(i, 1).column(id_col), 0, hashlib.sha256(), hashlib.sha256()]
                now[2] += len(ids) // 4
                now[3].update(ids)
                now[4].update(codec.text_bytes(ids))
        if now:
            yield out()

    return rows.mapInArrow(at_once, schema).unionByName(parts.mapInArrow(run, schema))
