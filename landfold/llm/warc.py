"""WARC archives: a writer with revisit records, and a reader that salvages what it can of damaged files.

The writer gives each page a gzip member of its own and rolls files at SEGMENT_BYTES, so that a file fits a task. File
names follow the task's partition and contents follow its rows, and a file appears by a rename, so a repeated task
writes the same archive again. Of pages with equal payloads of REVISIT_BYTES or more, the one with the largest page_id
is the response and the others are revisit records without payload.

The reader takes (path, content) rows, as Spark's binaryFile source gives them, compressed by record or plain. A record
must have a version line, headers, its full block and matching digests. Where that fails, the reader searches for the
next gzip member or version line from which a whole record can be read, goes on there, and logs the bytes between as a
gap with the reason. A member is inflated as far as it goes and searched the same way, so its other records are kept; its
inner gaps name their inner bytes. A record that ends just where a broken member ends is part of the gap.

Null html is an empty payload; a null url has no target; pages without page_id are always responses. Rows that repeat a
page_id and payload are all responses if that id is the largest. An empty table gives no archive and no records.
Further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.session import checkpoint_dir, cut_lineage

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 20
CRAWL_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.gz"
STEP = 1 << 16
FOUND = ("path string, kind string, start bigint, end bigint, reason string, record_id string, record_type string, target_uri string, "
         "refers_to string, payload_digest string, payload_bytes bigint, payload binary")
FOUND_FIELDS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("record_id", pa.string()),
                          ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                          ("payload_bytes", pa.int64()), ("payload", pa.binary())])


class Damaged(ValueError):
    """No whole record can be read at this place."""


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = CRAWL_DATE) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += [f"WARC-Block-Digest: {_sha1(block)}", f"WARC-Payload-Digest: {_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to). Only ids and digests meet by digest; the html is shuffled once, by page."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(raw).alias("digest_"), F.octet_length(raw).alias("bytes_"))
    ids = rows.where(F.col("bytes_") >= least).select("page_id", "digest_")
    last = ids.groupBy("digest_").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    revisits = ids.join(last, "digest_").where("page_id <> refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest_"], "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> tuple[str, DataFrame]:
    """Writes the archives and returns their folder (in the shared checkpoint folder unless given) and the rows (path, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held, size, number = [], 0, 0

        def roll():
            nonlocal held, size, number
            name = f"{root}/part-{part:06d}-{number:04d}{SUFFIX}"
            with store.open_output_stream(f"{name}.{attempt}", compression=None) as out:
                for piece in held:
                    out.write(piece)
            store.move(f"{name}.{attempt}", name)
            row = pa.RecordBatch.from_pydict({"path": [name], "records": [len(held)], "bytes": [size]})
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                held.append(member(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)))
                size += len(held[-1])
                if size >= segment_bytes:
                    yield roll()
        if held:
            yield roll()

    return folder, cut_lineage(with_revisits(pages, least).mapInArrow(run, "path string, records bigint, bytes bigint"))


def _inflated(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The contents of the gzip member at this place as far as they inflate, where it ends, and why it is not whole."""
    unpack, parts, now = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            step = data[now:now + STEP]
            if not step:
                return b"".join(parts), now, "member is cut off"
            whole = unpack.copy()
            parts.append(unpack.decompress(step))
            now += len(step)
    except zlib.error as broken:
        for k in range(len(step)):  # what the last step gives before the damage
            try:
                parts.append(whole.decompress(step[k:k + 1]))
            except zlib.error:
                break
        return b"".join(parts), now, f"member: {broken}"
    return b"".join(parts), now - len(unpack.unused_data), None


def _one(raw: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record whose version line is at this place."""
    size = STEP
    head = bytes(raw[at:at + size])
    while (stop := head.find(b"\r\n\r\n")) < 0 and head.startswith(b"WARC/1.") and at + size < len(raw):
        size *= 4
        head = bytes(raw[at:at + size])
    if not head.startswith(b"WARC/1.") or stop < 0:
        raise Damaged("no version line" if stop >= 0 or not head.startswith(b"WARC/1.") else "headers do not end")
    headers = {}
    for line in head[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = at + stop + 4
    end = start + int(headers["content-length"])
    block = bytes(raw[start:end])
    if len(block) < end - start or bytes(raw[end:end + 4]) != b"\r\n\r\n":
        raise Damaged("block has another length")
    if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise Damaged("block digest differs")
    return headers, block, end + 4


def _fields(headers: dict[str, str], block: bytes) -> dict:
    http, parted, payload = block.partition(b"\r\n\r\n")
    if not parted:
        http, payload = b"", block
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "")
    if kind == "revisit":
        sizes = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        hexed = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest.startswith("sha1:") else None
        size, payload = (int(sizes[0]) if sizes else None), None
    else:
        if digest and digest != _sha1(payload):
            raise Damaged("payload digest differs")
        hexed, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"record_id": headers.get("warc-record-id"), "record_type": kind, "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"),
            "payload_digest": hexed, "payload_bytes": size, "payload": payload}


def _inner(raw: bytes) -> Iterator[dict]:
    """Records of inflated bytes, and the gaps between them with their inner offsets."""
    at = 0
    while at < len(raw):
        end, why = at, None
        while True:
            try:
                headers, block, after = _one(raw, end)
                row = {"kind": "record", **_fields(headers, block)}
                break
            except Damaged as broken:
                why = why or str(broken)
                end = raw.find(b"WARC/1.", end + 1)
                if end < 0:
                    row, end, after = None, len(raw), len(raw)
                    break
        if why:
            yield {"kind": "gap", "reason": why, "inner": (at, end)}
        if row:
            yield row
        at = after


def _read_at(data: memoryview, at: int) -> tuple[list[dict], int, str | None]:
    """The records and inner gaps of the gzip member, or the plain record, at this place, its end, and why it is not whole."""
    if bytes(data[at:at + 2]) != b"\x1f\x8b":
        headers, block, end = _one(data, at)
        return [{"kind": "record", **_fields(headers, block)}], end, None
    raw, end, why = _inflated(data, at)
    found = list(_inner(raw))
    if why and found and found[-1]["kind"] == "record":  # it ends where the member breaks, so nothing shows that its member went on well
        found.pop()
    if not any(x["kind"] == "record" for x in found):
        raise Damaged(why or (found[0]["reason"] if found else "member is empty"))
    for x in found:
        if x["kind"] == "gap":
            x["reason"] += " at inner bytes {}-{}".format(*x.pop("inner"))
    return found, end, why


def _candidates(content: bytes, at: int) -> Iterator[int]:
    """Later places at which a member or a version line may begin, in order."""
    marks = (b"\x1f\x8b\x08", b"WARC/1.")
    ahead = [content.find(m, at) for m in marks]
    while max(ahead) >= 0:
        here = min(a for a in ahead if a >= 0)
        yield here
        for k, m in enumerate(marks):
            if ahead[k] == here:
                ahead[k] = content.find(m, here + 1)


def _resume(content: bytes, data: memoryview, at: int) -> int:
    """The next place from which something can be read, or the end."""
    for end in _candidates(content, at):
        try:
            _read_at(data, end)
            return end
        except Damaged:
            continue
    return len(data)


def salvaged(content: bytes) -> Iterator[dict]:
    """Records and gaps of one archive in order; together they cover it. Gaps inside a member have its place and name their inner bytes."""
    data, at = memoryview(content), 0
    while at < len(data):
        try:
            found, end, why = _read_at(data, at)
        except Damaged as broken:
            found, why = [], str(broken)
        if why:
            end = _resume(content, data, at + 1)
        for one in found:
            yield {"start": at, "end": end, **one}
        if why:
            yield {"kind": "gap", "start": at, "end": end, "reason": why}
        at = end


def read(files: DataFrame) -> DataFrame:
    """One row per record and per quarantined gap of archives (path, content); columns as in FOUND."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                rows, size = [], 0
                for row in salvaged(batch.column("content")[i].as_py() or b""):
                    rows.append({"path": path} | row)
                    size += len(row.get("payload") or b"") + 200
                    if size > STEP * 16:
                        yield pa.RecordBatch.from_pylist(rows, FOUND_FIELDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FOUND_FIELDS)

    return files.select("path", "content").mapInArrow(run, FOUND)


def archives(spark, folder: str) -> DataFrame:
    """(path, content) of the archives in a folder; files that an interrupted task left have another suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")
