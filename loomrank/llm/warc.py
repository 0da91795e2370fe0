"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Writing.  Records are WARC/1.1, each a gzip member of its own (or plain).  Of the
records with equal payloads the one with the smallest page id is a response, the
others are revisits that refer to it.  Executors write through Spark's text
writer, so any file system that Spark reaches will do: every row is a record
without its last byte, and the writer's line separator is that byte.  A plain
record ends in a line feed.  A gzip member ends in the high byte of its length,
zero for records below 16 MiB; a longer one is followed by an empty member.

Reading.  A record counts if its member inflates with the right checksum, its
headers parse, its block has the announced length and its block digest fits.
Where a check fails, the reader searches for the next byte that starts a valid
member or version line, goes on from there and logs the bytes in between.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm import scratch

VERSION, DATE = b"WARC/1.1", "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:x-page:%s>"
_EMPTY = bytes.fromhex("1f8b08000000000000ff0300000000000000" + "0000")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_FEED = 1 << 14


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One record; with refers_to a revisit, which keeps the response's headers and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda x: _ID % ("" if x is None else x)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", _PROFILE)]
    head += [
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _records(gzip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, first = (batch.column(c).to_pylist() for c in ("page_id", "url", "first"))
            out = []
            for page, url, html, one in zip(ids, urls, batch.column("html"), first, strict=True):
                data = record(page, url, (html.as_py() or "").encode(), one)
                if gzip:
                    data = member(data)
                    data = data if data[-1] == 0 else data + _EMPTY
                out.append(data[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write(pages: DataFrame, path: str, least: int = 0, gzip: bool = True) -> None:
    """Writes a record per page (page_id, url, html); payloads below `least` bytes are never revisits.

    A null html is an empty payload, a null url is left out, a page without an id
    is a response.  A row that repeats is written as often; of equal payloads all
    rows of the smallest page id are responses.
    """
    text = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("size")).where(F.col("size") >= least)
    firsts = scratch.saved(digests.groupBy("digest").agg(F.min("page_id").alias("first")), "firsts")
    revisits = digests.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    rows = pages.select("page_id", "url", "html", F.sha1(text.cast("binary")).alias("digest")).join(revisits, ["page_id", "digest"], "left").drop("digest")
    lines = rows.mapInArrow(_records(gzip), "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\0" if gzip else "\n").text(path)
    scratch.drop(firsts)
    scratch.release(pages.sparkSession)


def parse(data: bytes) -> tuple[dict[str, str], bytes] | str:
    """Headers and block of one whole record, or what is wrong with it."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return "no version line and headers"
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return "a header without a colon"
        name = key.strip().lower().decode("latin-1")
        if name in headers and name != "warc-concurrent-to":
            return "a header twice"
        headers[name] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        return "no content length"
    n = int(headers["content-length"])
    if len(rest) < n or rest[n : n + 4] != b"\r\n\r\n":
        return "the block doesn't end where it should"
    block = rest[:n]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        return "the block's digest differs"
    headers[""] = str(len(head) + 4 + n + 4)
    return headers, block


def _extent(raw: bytes, at: int) -> int | str:
    """Where the record that a version line begins would end, or why there is none: headers are read a line at a time, so a false start costs no more than its own lines."""
    seen, length, line = set(), None, raw.find(b"\r\n", at)
    while line >= 0:
        end = raw.find(b"\r\n", line + 2)
        if end < 0:
            break
        if end == line + 2:
            if length is None:
                return "no content length"
            stop = end + 2 + length + 4
            return stop if stop <= len(raw) and raw[stop - 4 : stop] == b"\r\n\r\n" else "the block doesn't end where it should"
        name, colon, value = raw[line + 2 : end].partition(b":")
        name = name.strip().lower()
        if not colon:
            return "a header without a colon"
        if name in seen and name != b"warc-concurrent-to":
            return "a header twice"
        seen.add(name)
        if name == b"content-length" and value.strip().isdigit():
            length = int(value)
        line = end
    return "no version line and headers"


def _inflated(data: memoryview, at: int) -> tuple[bytes, int] | str:
    z, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            parts.append(z.decompress(data[pos : pos + _FEED]))
            pos += _FEED
    except zlib.error as e:
        return f"a broken gzip member: {e}"
    if not z.eof:
        return "a gzip member without an end"
    return b"".join(parts), min(pos, len(data)) - len(z.unused_data)


class _Nuls:
    """The next zero byte at or after a place; places only grow, so the file is searched once."""

    def __init__(self, raw: bytes):
        self.raw, self.found = raw, -1

    def after(self, at: int) -> int:
        if self.found < at:
            self.found = self.raw.find(b"\0", at)
            if self.found < 0:
                self.found = len(self.raw)
        return self.found


def _headed(raw: bytes, at: int, nuls: _Nuls) -> bool:
    """Whether a gzip header that begins there ends within the file."""
    flags, at = raw[at + 3] if at + 3 < len(raw) else 0xFF, at + 10
    if flags & 0xE0:
        return False
    if flags & 4:
        at += 2 + int.from_bytes(raw[at : at + 2], "little")
    for bit in (8, 16):  # a name, a comment
        if flags & bit:
            at = nuls.after(at) + 1
    return at < len(raw)


def salvage(raw: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason, None), in file order."""
    data, at, bad, why = memoryview(raw), 0, -1, ""
    n, nuls = len(data), _Nuls(raw)
    while at < n:
        if data[at : at + 3] == b"\x1f\x8b\x08":
            got = _inflated(data, at) if _headed(raw, at, nuls) else "a gzip header without an end"
            if not isinstance(got, str):
                inner, end = got
                got = parse(inner) if inner else None
                if got and not isinstance(got, str) and int(got[0][""]) != len(inner):
                    got = "bytes behind the record in its member"
        elif data[at : at + 5] == b"WARC/":
            end = _extent(raw, at)
            got = parse(raw[at:end]) if isinstance(end, int) else end
        else:
            got = "neither a gzip member nor a version line"
        if not isinstance(got, str):
            if bad >= 0:
                yield "gap", bad, at - bad, why, None
                bad = -1
            if got:
                yield "record", at, end - at, got[0], got[1]
            at = end
            continue
        if bad < 0:
            bad, why = at, got
        following = _START.search(raw, at + 1)
        at = following.start() if following else n
    if bad >= 0:
        yield "gap", bad, n - bad, why, None


def _page(name: str | None):
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


_ROW = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()),
])


def _read(payloads: bool):
    def row(path: str, kind: str, offset: int, length: int, what, block) -> tuple:
        if kind == "gap":
            return (kind, path, offset, length, what, *[None] * 7)
        http, _, payload = block.partition(b"\r\n\r\n")
        type_ = what.get("warc-type")
        digest = what.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        if type_ == "response":
            own = base32_sha1(payload)
            if digest not in (None, own):
                return ("gap", path, offset, length, "the payload's digest differs", *[None] * 7)
            digest, n = own, len(payload)
        else:
            n = int(size[1]) if size else None
        return (kind, path, offset, length, None, _page(what.get("warc-record-id")), what.get("warc-target-uri"), type_, _page(what.get("warc-refers-to")), n, digest, payload if payloads and type_ == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for found in salvage(content.as_py() or b""):
                    rows.append(row(path, *found))
                    size += found[2]
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind "record" and, for quarantined bytes, "gap", with path, offset and length.

    A file is one row of its bytes on the way in; the writer keeps files small.
    """
    schema = (
        "kind string, path string, offset long, length long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(payloads), schema)
