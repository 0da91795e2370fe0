"""The Common Index File Format: length-delimited protobuf messages, read by a Python data source.

A file is a header, then the postings lists, then the document records.  Nothing in
it says where messages begin, so positions() finds them in one distributed pass over
ranges of bytes and stores some of them beside the file.  With that, the driver
reads a header and a list of positions, tasks seek to their own parts, and a list or
a document is looked up by its number.  Without it (a store that can't be written) the
driver walks the message lengths.  A path may also be a folder of such files
(*.ciff), each with documents of its own; one that our sink wrote has a manifest, and
is refused where its files aren't those that it names.  For stores that only Spark
reaches, read() takes a single file through Spark's binary reader, whole and in one
task.
"""

from __future__ import annotations

import bisect
import io
import json
import logging
import os
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomrank import schema as S

log = logging.getLogger(__name__)
TABLES = {"header": S.CIFF_HEADER, "postings": S.CIFF_POSTINGS, "docs": S.CIFF_DOCS}
#: Bytes of messages per task.
SPLIT = 32 << 20
#: Messages between two stored positions at most, and what the file with them is called.
STRIDE, POSITIONS = 256, ".positions"
#: Beside a folder that our sink wrote.
MANIFEST = ".manifest.json"
#: Lookups that get a task each; more of them share tasks.
LOOKUPS = 64
#: Messages that must follow one another for a guessed beginning to be tried.
CHAIN = 4
#: A posn is the message's position in its file, with the file's number above so many bits.
FILE_BITS = 40


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return out, at
        shift += 7


def _signed(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: integers, 8-byte and 4-byte values as bytes, strings and messages as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} isn't known")
        yield key >> 3, value


def decode_header(data: bytes) -> tuple:
    f = dict(fields(data))
    ints = [_signed(f.get(i, 0), 32) for i in range(1, 6)]
    average = struct.unpack("<d", f[7])[0] if 7 in f else 0.0
    return (*ints, _signed(f.get(6, 0), 64), average, f.get(8, b"").decode())


def decode_postings(data: bytes) -> tuple:
    term, df, cf, postings = "", 0, 0, []
    for number, value in fields(data):
        if number == 1:
            term = value.decode()
        elif number == 2:
            df = _signed(value, 64)
        elif number == 3:
            cf = _signed(value, 64)
        elif number == 4:
            p = dict(fields(value))
            postings.append((_signed(p.get(1, 0), 32), _signed(p.get(2, 0), 32)))
    return term, df, cf, postings


def decode_doc(data: bytes) -> tuple:
    f = dict(fields(data))
    return _signed(f.get(1, 0), 32), f.get(2, b"").decode(), _signed(f.get(3, 0), 32)


_DECODE = {"postings": decode_postings, "docs": decode_doc}


def _length(f: BinaryIO) -> int | None:
    """The next message's length; None at the end."""
    out = shift = 0
    while byte := f.read(1):
        out |= (byte[0] & 0x7F) << shift
        if byte[0] < 0x80:
            return out
        shift += 7
    return None


def layout(f: BinaryIO, table: str, split: int = SPLIT) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The header's bytes, and (offset, messages, first position) of each part of a table."""
    head = f.read(_length(f) or 0)
    counts = dict(zip(("postings", "docs"), decode_header(head)[1:3], strict=True))
    parts: list[tuple[int, int, int]] = []
    for name, many in counts.items():
        offset, first = f.tell(), 0
        for i in range(many):
            n = _length(f)
            if n is None:
                raise ValueError("the file ends before its last message")
            f.seek(n, os.SEEK_CUR)
            if f.tell() - offset >= split or i == many - 1:
                if name == table:
                    parts.append((offset, i + 1 - first, first))
                offset, first = f.tell(), i + 1
        if name == table:
            break
    return head, parts


def messages(f: BinaryIO, offset: int, many: int, first: int, table: str, skip: int = 0) -> Iterator[tuple]:
    f.seek(offset)
    for _ in range(skip):
        f.seek(_length(f) or 0, os.SEEK_CUR)
    for i in range(many):
        n = _length(f)
        data = f.read(n)
        if len(data) < n:
            raise ValueError("the file ends inside a message")
        yield (first + i, *_DECODE[table](data))


def _raw(f: BinaryIO, offset: int, many: int, skip: int) -> Iterator[bytes]:
    """The bytes of messages."""
    f.seek(offset)
    for _ in range(skip):
        f.seek(_length(f) or 0, os.SEEK_CUR)
    for _ in range(many):
        n = _length(f)
        data = f.read(n)
        if len(data) < n:
            raise ValueError("the file ends inside a message")
        yield data


def _term(data: bytes) -> tuple[str, int] | None:
    """The term that a list begins with, and where it ends; None where another field comes first."""
    if data[:1] != b"\n":
        return None
    n, at = varint(data, 1)
    return data[at : at + n].decode(), at + n


def decode_lists(first: int, lists: list[bytes]) -> pa.RecordBatch:
    """decode_postings() of many messages at once, with their positions from `first` on.

    What follows a term is varints alone: df, cf, and for each posting a tag, a length, and
    a tag and a value for its gap (left out where it is 0, as the first may be) and its tf.
    Messages that aren't built so are decoded field by field.
    """
    terms, rests, odd = [], [], set()
    for i, data in enumerate(lists):
        found = _term(data)
        rest = data[found[1] :] if found else b""
        if not rest or rest[-1] >= 0x80:
            odd.add(i)
            rest = b"\0"
        terms.append(found[0] if found else "")
        rests.append(rest)
    data = np.frombuffer(b"".join(rests), np.uint8)
    ends = np.flatnonzero(data < 0x80)
    begins = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - begins + 1
    values = (data[begins] & 0x7F).astype(np.uint64)
    for k in range(1, min(int(sizes.max(initial=0)), 10)):
        longer = np.flatnonzero(sizes > k)
        values[longer] |= (data[begins[longer] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    edges = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(x) for x in rests]) - 1, side="right")])
    many = np.diff(edges)
    short = (many >= 8) & ((many - 4) % 6 == 4)  # the first gap is 0
    base = np.where(short, 8, 4)
    nth, base_of = np.arange(len(values)) - np.repeat(edges[:-1], many), np.repeat(base, many)
    place = np.where(nth >= base_of, (nth - base_of) % 6, -1)
    tags = np.full(len(values), -1, np.int64)
    for where, tag in ((place == 0, 0x22), (place == 2, 0x08), (place == 4, 0x10), (nth == 0, 0x10), (nth == 2, 0x18), ((nth == 4) & (place < 0), 0x22), ((nth == 6) & (place < 0), 0x10)):
        tags[where] = tag
    wrong = ((tags >= 0) & (values.astype(np.int64) != tags)) | (sizes > 10)
    total = np.concatenate([[0], np.cumsum(sizes)])
    for where, fields in ((place == 1, 4), ((nth == 5) & (place < 0), 2)):
        at = np.flatnonzero(where)
        inside = total[np.minimum(at + 1 + fields, len(values))] - total[at + 1]
        wrong[at[values[at] != inside.astype(np.uint64)]] = True
    odd |= set(np.flatnonzero((many < 4) | ((many - base) % 6 != 0)).tolist())
    odd |= set(np.repeat(np.arange(len(lists)), many)[wrong].tolist())
    good = np.ones(len(lists), bool)
    good[list(odd)] = False
    slow = {i: decode_postings(lists[i]) for i in odd}
    counts = (many - base) // 6 + short
    for i, x in slow.items():
        terms[i], counts[i] = x[0], len(x[3])
    offsets = np.concatenate([[0], np.cumsum(counts)])
    df, cf = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    df[good], cf[good] = values[edges[:-1][good] + 1].view(np.int64), values[edges[:-1][good] + 3].view(np.int64)
    docids, tfs = np.zeros(offsets[-1], np.int32), np.zeros(offsets[-1], np.int32)
    fast, own = np.repeat(good, many), np.repeat(good, counts)
    zero = offsets[:-1][good & short]
    gapped = own.copy()
    gapped[zero] = False
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    docids[gapped] = low[fast & (place == 3)]
    tfs[own] = low[fast & ((place == 5) | ((nth == 7) & (place < 0)))]
    for i, (_, d, c, postings) in slow.items():
        df[i], cf[i] = d, c
        if postings:
            docids[offsets[i] : offsets[i + 1]], tfs[offsets[i] : offsets[i + 1]] = zip(*postings, strict=True)
    postings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(docids), pa.array(tfs)], ["docid", "tf"]))
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lists)), pa.int64()), pa.array(terms), pa.array(df), pa.array(cf), postings], ["posn", "term", "df", "cf", "postings"])


def _batches(f: BinaryIO, offset: int, many: int, first: int, skip: int) -> Iterator[pa.RecordBatch]:
    """Lists in batches of about a megabyte."""
    held, size = [], 0
    for data in _raw(f, offset, many, skip):
        held.append(data)
        size += len(data)
        if size >= 1 << 20 or len(held) == 10_000:
            yield decode_lists(first, held)
            first, held, size = first + len(held), [], 0
    if held:
        yield decode_lists(first, held)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Incomplete(ValueError):
    """A folder whose files aren't those of its manifest, or a write that didn't end."""


def files(path: str) -> list[str]:
    """The file itself, or the *.ciff files of a folder, by name; a folder's manifest must agree with them."""
    system, at = store(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [at]
    inside = [x for x in system.get_file_info(fs.FileSelector(at)) if x.is_file]
    found = sorted((x for x in inside if x.extension == "ciff"), key=lambda x: x.path)
    if system.get_file_info(at + MANIFEST).type == fs.FileType.File:
        with system.open_input_file(at + MANIFEST) as f:
            want = {x["name"]: x["length"] for x in json.loads(f.read())["files"]}
        got = {x.base_name: x.size for x in found}
        wrong = sorted(n for n in want.keys() | got.keys() if want.get(n) != got.get(n))
        if wrong:
            raise Incomplete(f"{path} isn't what was written: {wrong[0]} and {len(wrong) - 1} others")
    elif any(x.extension == "part" for x in inside):
        raise Incomplete(f"{path} has no manifest: its write didn't end")
    return [x.path for x in found]


def opened(path: str, at: str) -> BinaryIO:
    return io.BufferedReader(store(path)[0].open_input_file(at), 1 << 20)


# ---- where messages begin -------------------------------------------------------------------------------------------

_LIST = {1: 2, 2: 0, 3: 0, 4: 2}
_DOC = {1: 0, 2: 2, 3: 0}
_MAYBE = re.compile(rb"[\x80-\xff]{0,4}[\x01-\x7f](?=[\x08\x0a\x10\x12\x18\x22])")


def _plausible(data: bytes, at: int, end: int) -> bool:
    """Whether the fields that lie wholly in data[at:end] are those of a list or of a record; data may stop before the message does."""
    kinds = [_LIST, _DOC]
    try:
        while at < end and kinds:
            key, at = varint(data, at)
            kinds = [k for k in kinds if k.get(key >> 3) == key & 7]
            n, at = varint(data, at)
            if key & 7 == 2:
                at += n
                if at > end:
                    return False
        return bool(kinds) and at == end
    except IndexError:
        return bool(kinds)


def _resynchronised(f: BinaryIO, start: int, stop: int, size: int) -> int | None:
    """The first place from start on, before stop, that CHAIN plausible messages follow."""
    for low in range(start, stop, 1 << 20):
        f.seek(low)
        data = f.read((1 << 20) + 16)
        for found in _MAYBE.finditer(data):
            for first in range(found.start(), found.end()):  # a length may begin at any of the bytes before its last
                at = low + first
                if at >= min(stop, low + (1 << 20)):
                    break
                good = 0
                while good < CHAIN and at < size:
                    f.seek(at)
                    head = f.read(4096)
                    try:
                        n, begin = varint(head, 0)
                    except IndexError:
                        break
                    if at + begin + n > size or not _plausible(head, begin, begin + n):
                        break
                    at, good = at + begin + n, good + 1
                if good == CHAIN or (good and at == size):
                    return low + first
    return None


def _walked(f: BinaryIO, start: int, stop: int, grain: int) -> tuple[list[tuple[int, int]], int, int]:
    """(number, offset) of some of the messages that begin from start and before stop, how many there are, and where the last one ends.

    Between two of those kept are less than STRIDE messages and `grain` bytes, or a single message.
    """
    f.seek(start)
    at, many, kept = start, 0, []
    while at < stop:
        if not kept or many - kept[-1][0] >= STRIDE or at - kept[-1][1] >= grain:
            kept.append((many, at))
        n = _length(f)
        if n is None:
            break
        at = f.seek(n, os.SEEK_CUR)
        many += 1
    return kept, many, at


def _ranges(path: str, at: str, size: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nth, start, stop, known in zip(*(batch.column(c).to_pylist() for c in ("nth", "start", "stop", "known")), strict=True):
                with opened(path, at) as f:
                    begin = start if known else _resynchronised(f, start, stop, size)
                    kept, many, end = _walked(f, begin, stop, grain) if begin is not None else ([], 0, 0)
                rows.append({"nth": nth, "begin": begin, "end": end, "many": many, "kept": [{"number": n, "offset": o} for n, o in kept]})
            yield pa.RecordBatch.from_pylist(rows, schema=_RANGES)

    return run


_RANGES = pa.schema([("nth", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("many", pa.int64()), ("kept", pa.list_(pa.struct([("number", pa.int64()), ("offset", pa.int64())])))])


def _beside(path: str, at: str) -> str:
    """Where a file's positions are: next to it, or next to its folder."""
    own = store(path)[1]
    return at + POSITIONS if own == at else f"{own}{POSITIONS}/{at.rsplit('/', 1)[-1]}"


def positioned(spark: SparkSession, path: str, least: int = SPLIT) -> None:
    """Stores positions of the files of at least so many bytes that have none yet; a store that can't be written is left as it is."""
    system, _ = store(path)
    large = [at for at in files(path) if system.get_file_info(at).size >= least and stored_positions(path, at) is None]
    if large:
        try:
            positions(spark, path, only=large)
        except OSError as e:
            log.warning("no positions stored for %s, so the driver walks it: %s", path, e)


def positions(spark: SparkSession, path: str, split: int = SPLIT, only: list[str] | None = None) -> None:
    """Stores, beside each file of the path (or each of `only`), where its messages begin.

    Every range of `split` bytes is walked by a task from a beginning that it guesses;
    the guess is only kept where the range before it ends there, and otherwise the
    range is walked again from that end.  The first range's beginning is known, so
    all of them are right in the end, whatever bytes a file holds.
    """
    for at in only or files(path):
        system, _ = store(path)
        info = system.get_file_info(at)
        size = info.size
        with opened(path, at) as f:
            head = decode_header(f.read(_length(f) or 0))
            start = f.tell()
        edges = list(range(start, size, split)) or [start]
        todo = [(i, a, min(a + split, size), i == 0) for i, a in enumerate(edges)]
        found: dict[int, dict] = {}
        while todo:
            ranges = spark.createDataFrame(todo, "nth long, start long, stop long, known boolean").repartitionByRange(len(todo), "nth")
            for r in ranges.mapInArrow(_ranges(path, at, size, split // 4), "nth long, begin long, end long, many long, kept array<struct<number: long, offset: long>>").collect():  # a row a range, positions by the STRIDE
                found[r["nth"]] = r.asDict()
            todo, end = [], start
            for i, a in enumerate(edges):
                stop, r = min(a + split, size), found[i]
                if end >= stop:  # inside a message that began earlier
                    found[i] = {"begin": None, "end": end, "many": 0, "kept": []}
                elif r["begin"] != end:
                    todo = [(i, end, stop, True)]
                    break
                else:
                    end = r["end"]
        numbers, offsets, before = [], [], 0
        for i in range(len(edges)):
            for kept in found[i]["kept"]:
                numbers.append(before + kept["number"])
                offsets.append(kept["offset"])
            before += found[i]["many"]
        if before < head[1] + head[2]:
            raise ValueError("the file ends before its last message")
        store_positions(path, at, numbers, offsets, head[1], head[2])


def store_positions(path: str, at: str, numbers: list[int], offsets: list[int], lists: int, docs: int) -> None:
    """Stores numbers and offsets of messages beside their file, with what tells whether the file is still the same."""
    system, _ = store(path)
    info = system.get_file_info(at)
    facts = {"size": str(info.size), "written": str(info.mtime_ns), "lists": str(lists), "docs": str(docs)}
    out = pa.table({"number": pa.array(numbers, pa.int64()), "offset": pa.array(offsets, pa.int64())}).replace_schema_metadata(facts)
    beside = _beside(path, at)
    system.create_dir(beside.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(beside) as f:
        pq.write_table(out, f)


def stored_positions(path: str, at: str) -> tuple[list[int], list[int], int, int] | None:
    """Numbers, offsets, lists and documents; None where there are none for the file as it is."""
    system, _ = store(path)
    beside, info = _beside(path, at), system.get_file_info(at)
    if system.get_file_info(beside).type != fs.FileType.File:
        return None
    with system.open_input_file(beside) as f:
        found = pq.read_table(f)
    facts = {k.decode(): int(v) for k, v in found.schema.metadata.items() if k in (b"size", b"written", b"lists", b"docs")}
    if (facts["size"], facts["written"]) != (info.size, info.mtime_ns):
        return None
    return found["number"].to_pylist(), found["offset"].to_pylist(), facts["lists"], facts["docs"]


def _within(path: str, at: str, table: str, only: list[int] | None, split: int) -> list[tuple[int, int, int, int]] | None:
    """(offset, messages, first position, messages to skip) of each part of a table, from stored positions; only: of these numbers."""
    stored = stored_positions(path, at)
    if stored is None:
        return None
    numbers, offsets, lists, docs = stored
    low, high = (0, lists) if table == "postings" else (lists, lists + docs)
    if only is not None:
        out = []
        for n in only:
            i = bisect.bisect_right(numbers, low + n) - 1
            out.append((offsets[i], 1, n, low + n - numbers[i]))
        return out
    out, first = [], low
    while first < high:
        i = bisect.bisect_right(numbers, first) - 1
        j = max(bisect.bisect_left(offsets, offsets[i] + split), i + 1)
        end = min(numbers[j] if j < len(numbers) else high, high)
        out.append((offsets[i], end - first, first - low, first - numbers[i]))
        first = end
    return out


class _Part(InputPartition):
    def __init__(self, at: str, offset: int, many: int, first: int, skip: int = 0):
        self.at, self.offset, self.many, self.first, self.skip = at, offset, many, first, skip


class _Parts(InputPartition):
    """Several lookups of a task."""

    def __init__(self, parts: list[_Part]):
        self.parts = parts


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, only: list[tuple[int, int]] | None = None, split: int = SPLIT):
        self.path, self.table, self.only, self.split = path, table, only, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for number, at in enumerate(files(self.path)):
            if self.table == "header":
                out.append(_Part(at, 0, 1, 0))
                continue
            only = None if self.only is None else [n for f, n in self.only if f == number]
            if only == []:
                continue
            parts = _within(self.path, at, self.table, only, self.split)
            if parts is None:
                with opened(self.path, at) as f:
                    parts = [(*p, 0) for p in layout(f, self.table, self.split)[1]]
                if only is not None:
                    parts = [(offset, 1, n, n - first) for offset, many, first, _ in parts for n in only if first <= n < first + many]
            out += [_Part(at, offset, many, first + (number << FILE_BITS), skip) for offset, many, first, skip in parts]
        if self.only is not None and len(out) > LOOKUPS:
            tasks = max(LOOKUPS, -(-len(out) // 1024))
            return [_Parts(out[i * len(out) // tasks : (i + 1) * len(out) // tasks]) for i in range(tasks)]
        return out or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part | _Parts) -> Iterator[tuple | pa.RecordBatch]:
        if isinstance(partition, _Parts):
            for part in partition.parts:
                yield from self.read(part)
            return
        if not partition.many:
            return
        with opened(self.path, partition.at) as f:
            if self.table == "header":
                yield decode_header(f.read(_length(f) or 0))
            elif self.table == "postings":
                yield from _batches(f, partition.offset, partition.many, partition.first, partition.skip)
            else:
                yield from messages(f, partition.offset, partition.many, partition.first, self.table, partition.skip)


class CiffSource(DataSource):
    """spark.read.format("ciff").option("table", "postings").load(path); split: bytes of messages per task, only: positions to look up."""

    @classmethod
    def name(cls) -> str:
        return "ciff"

    def schema(self) -> StructType:
        return TABLES[self.options.get("table", "postings")]

    def reader(self, schema: StructType) -> DataSourceReader:
        only = self.options.get("only")
        numbers = None if only is None else [divmod(int(x), 1 << FILE_BITS) for x in only.split(",") if x]
        return _Reader(self.options["path"], self.options.get("table", "postings"), numbers, int(self.options.get("split", SPLIT)))


def _whole(table: str, kind: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            for content in batch.column("content"):
                f = io.BytesIO(content.as_py())
                head, parts = layout(f, table, 1 << 22)
                rows = [[decode_header(head)]] if table == "header" else (list(messages(f, *p, table)) for p in parts)
                for part in rows:
                    names = arrow.names
                    cooked = [dict(zip(names, r, strict=True)) | ({"postings": [{"docid": d, "tf": t} for d, t in r[4]]} if table == "postings" else {}) for r in part]
                    yield pa.RecordBatch.from_pylist(cooked, schema=arrow)

    return run


def read(spark: SparkSession, path: str, table: str = "postings", split: int = SPLIT) -> DataFrame:
    """A table of a CIFF file or of a folder of them: header (a row per file), postings or docs; about `split` bytes of messages per task."""
    try:
        store(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):  # not a store that pyarrow opens here
        kind, scan = TABLES[table], spark.read.format("binaryFile").load(path)
        if scan.select("path").limit(2).count() > 1:
            raise ValueError("only one file at a time can be read from this store") from None
        return scan.select("content").mapInArrow(_whole(table, kind), kind)
    spark.dataSource.register(CiffSource)
    return spark.read.format("ciff").option("table", table).option("split", split).load(path)


def sizes_of(path: str, table: str) -> list[int]:
    """The lists or documents of each file, as its header counts them."""
    sizes = []
    for at in files(path):
        with opened(path, at) as f:
            sizes.append(decode_header(f.read(_length(f) or 0))[1 if table == "postings" else 2])
    return sizes


def lookup(spark: SparkSession, path: str, table: str, posns: list[int]) -> DataFrame:
    """The lists or documents of the given positions: a file's n-th has n, with the file's number above FILE_BITS bits.

    With stored positions each is read by itself, from at most STRIDE messages before it; numbers beyond the table are refused.
    """
    sizes = sizes_of(path, table)
    for posn in posns:
        number, n = divmod(posn, 1 << FILE_BITS)
        if not (0 <= number < len(sizes) and 0 <= n < sizes[number]):
            raise IndexError(f"no message {posn} in {path}")
    spark.dataSource.register(CiffSource)
    return spark.read.format("ciff").option("table", table).option("only", ",".join(map(str, posns))).load(path)


def _summed(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("postings")
            many = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, edges = column.flatten(), np.concatenate([[0], np.cumsum(many)])
            tfs, gaps = values.field("tf").to_numpy(zero_copy_only=False), values.field("docid").to_numpy(zero_copy_only=False).astype(np.int64)
            if (tfs < 0).any():
                raise ValueError("a negative term frequency")
            sums = np.concatenate([[0], np.cumsum(gaps & 0xFFFFFFFF if wide else gaps)])
            low = 0
            while low < len(many):  # lists of about so many postings at a time
                high = max(low + 1, int(np.searchsorted(edges, edges[low] + (1 << 17), side="right")) - 1)
                ids = sums[edges[low] + 1 : edges[high] + 1] - np.repeat(sums[edges[low:high]], many[low:high])
                nth = np.repeat(np.arange(low, high), many[low:high])
                wrong = np.flatnonzero((ids >= 1 << (32 if wide else 31)) | (ids < 0))
                if len(wrong):
                    term = batch.column("term")[int(nth[wrong[0]])].as_py()
                    raise ValueError(f"an id beyond {32 if wide else 31} bits in the list of {term!r}" + ("" if wide else "; wide=True takes unsigned ones"))
                if len(ids):
                    tf = pa.array(tfs[edges[low] : edges[high]])
                    yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(nth)), pa.array(ids if wide else ids.astype(np.int32)), tf], ["term", "doc_id", "tf"])
                low = high

    return run


def postings(lists: DataFrame, wide: bool = False, single: bool = False) -> DataFrame:
    """term, doc_id, tf: ids are running sums of the gaps; of a term's lists in a file the last one counts; negative tf are refused.

    wide: gaps are unsigned and ids long; else ids beyond 31 bits are refused.
    single: no file has two lists of a term (see single_lists()), so none has to be looked for.
    Lists are shuffled only where a file has several of a term.
    """
    if not single:
        own = lists.groupBy("term", F.shiftright("posn", FILE_BITS)).agg(F.max("posn").alias("posn"), F.count("*").alias("many"))
        if not own.where("many > 1").isEmpty():
            lists = lists.join(own.select("posn"), "posn", "left_semi")
    return lists.select("term", "postings").mapInArrow(_summed(wide), f"term string, doc_id {'long' if wide else 'int'}, tf int")


def single_lists(path: str) -> bool:
    """Whether a folder's manifest says that each file has one list of a term, as our sink writes them."""
    try:
        system, at = store(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    if system.get_file_info(at + MANIFEST).type != fs.FileType.File:
        return False
    files(path)  # refuses a folder that isn't its manifest's
    with system.open_input_file(at + MANIFEST) as f:
        return bool(json.loads(f.read()).get("single_lists"))


def docs(records: DataFrame, wide: bool = False) -> DataFrame:
    ids = F.col("docid").cast("long").bitwiseAND(0xFFFFFFFF) if wide else F.col("docid")
    return records.select(ids.alias("doc_id"), F.col("collection_docid").alias("ext_id"), F.col("doclength").alias("doc_len"))


# ---- writing, for fixtures and exchange -----------------------------------------------------------------------------


def _varint(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def _number(field: int, x: int) -> bytes:
    return _varint(field << 3) + _varint(x) if x else b""


def _bytes(field: int, x: bytes, always: bool = False) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(x)) + x if x or always else b""


def _message(x: bytes) -> bytes:
    return _varint(len(x)) + x


def encode_header(lists: int, docs: int, total: int, description: str = "") -> bytes:
    """The header's message; total is the sum of the documents' lengths."""
    head = _number(1, 1) + _number(2, lists) + _number(3, docs) + _number(4, lists) + _number(5, docs) + _number(6, total)
    return _message(head + _varint(7 << 3 | 1) + struct.pack("<d", total / docs if docs else 0.0) + _bytes(8, description.encode()))


def encode_list(term: str, own: list[tuple[int, int]]) -> bytes:
    """The message of a term's (doc_id, tf) with ascending ids."""
    parts, before = [_bytes(1, term.encode()), _number(2, len(own)), _number(3, sum(tf for _, tf in own))], 0
    for doc, tf in own:
        parts.append(_bytes(4, _number(1, doc - before) + _number(2, tf), always=True))
        before = doc
    return _message(b"".join(parts))


def _varints(out: np.ndarray, at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    """Writes varints of the given sizes to out."""
    for k in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        byte = ((values[own] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8)
        out[at[own] + k] = byte | np.where(sizes[own] > k + 1, 0x80, 0).astype(np.uint8)


def _varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each takes as a varint, none for zero."""
    return np.searchsorted(np.array([1 << (7 * k) for k in range(10)], np.uint64), values, side="right")


def encode_lists(terms: list[str], codes: np.ndarray, many: np.ndarray, bases: np.ndarray) -> list[bytes]:
    """encode_list() of many terms at once: of each `many` ascending codes, a document's number above `base` over 32 bits of tf."""
    edges = np.concatenate([[0], np.cumsum(many.astype(np.int64))])
    docs, tfs = (codes >> 32) + np.repeat(bases, many), (codes & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
    gaps = np.diff(docs, prepend=0)
    firsts = edges[:-1][many > 0]
    gaps[firsts] = docs[firsts]
    gaps, freqs = gaps.view(np.uint64), tfs.view(np.uint64)
    gap_sizes, tf_sizes = _varint_sizes(gaps), _varint_sizes(freqs)
    inner = gap_sizes + (gap_sizes > 0) + tf_sizes + (tf_sizes > 0)
    at = np.concatenate([[0], np.cumsum(inner + 2)])
    out = np.zeros(at[-1], np.uint8)
    out[at[:-1]], out[at[:-1] + 1] = 0x22, inner
    begin = at[:-1] + 2
    out[begin[gap_sizes > 0]] = 0x08
    _varints(out, begin + 1, gaps, gap_sizes)
    begin = begin + gap_sizes + (gap_sizes > 0)
    out[begin[tf_sizes > 0]] = 0x10
    _varints(out, begin + 1, freqs, tf_sizes)
    whole, cuts = out.tobytes(), at[edges].tolist()
    cfs = np.diff(np.concatenate([[0], np.cumsum(tfs)])[edges]).tolist()
    return [_message(b"".join((_bytes(1, t.encode()), _number(2, n), _number(3, cf), whole[a:b]))) for t, n, cf, a, b in zip(terms, many.tolist(), cfs, cuts, cuts[1:], strict=False)]


def encode_doc(doc: int, name: str, length: int) -> bytes:
    return _message(_number(1, doc) + _bytes(2, name.encode()) + _number(3, length))


def encode(lists: list[tuple[str, list[tuple[int, int]]]], records: list[tuple[int, str, int]], description: str = "") -> bytes:
    """A file of (term, [(doc_id, tf)]) with ascending ids and (doc_id, ext_id, doc_len) records."""
    head = encode_header(len(lists), len(records), sum(n for *_, n in records), description)
    return b"".join([head, *(encode_list(*x) for x in lists), *(encode_doc(*x) for x in records)])
