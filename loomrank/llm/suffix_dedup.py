"""Removal of repeated passages: starts are grouped by content-chosen anchors and then decided in shrinking runs.

A byte goes if it lies in a string of `length` bytes that also starts anywhere
else.  This isn't a suffix array by prefix doubling, which would sort one row per
byte and round (see the README); positions are counted in runs instead:

* Round 0 counts anchors.  The anchor of a start p is the leftmost
  k-gram with the smallest hash among the first `length - k + 1` k-grams of
  p's string.  Equal strings have their anchors at equal offsets, so all starts
  whose anchor's k-gram is unique are unique and leave at once.
* Each round then pairs the count of a run's common core with that of the
  whole stretch which its starts cover: runs with a unique core leave as unique,
  runs whose stretch repeats leave as repeated, the rest is cut into shorter runs
  (with longer cores) and counted anew, down to single starts whose core is the
  full string.

What repeats is decided by two 64-bit digests of the whole stretch beside its core's
fingerprint; fingerprints alone only ever rule starts out.  Counting uses partial aggregation, and positions get their counts back by a join
of two written tables that adaptive execution can split, so that one passage that
fills a third of the corpus doesn't meet in one task.

A row is known by its doc_id (0 if null) and a hash of its text; rows that agree in
both have the same text and hence the same removals, however often they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm import scratch
from loomrank.llm.bytescan import FIRST, U64, Rolling, chunks, digests, gather, lanes, mix

#: Starts per run in the rounds after the anchors'.
ROUNDS = (16, 4, 1)
#: Bytes at once: arrays of 8 bytes an item then stay in a core's cache.  Longer texts go in windows of so many starts.
SCAN = 1 << 18
#: Runs whose bytes are cut out at once.
CUT = 1 << 12
_POSITION = U64((1 << 28) - 1)  # places in a window
_SEEDS = (0xA4093822, 0x299F31D0)
_KEY = ["id", "twin"]

_hashes: list[Rolling] = []


def rolling() -> Rolling:
    if not _hashes:
        _hashes.append(Rolling(*FIRST))
    return _hashes[0]


def keyed(docs: DataFrame) -> DataFrame:
    """id, twin and text of every row: what names a row, and its text."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("twin"), "text")


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w neighbours."""
    s = 1
    while 2 * s <= w:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (w - s)], h[w - s :]) if s < w else h


def anchors(data: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...] | None:
    """Runs of starts with one anchor: document's row, anchor, first and last start, k-gram's fingerprint and the stretch's digests."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    h = mix(rolling().grams(rolling().prefix(data), k))
    order = (h & ~_POSITION) | np.arange(len(h), dtype=U64)
    anchor = (_least(order, length - k + 1) & _POSITION).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[:n] == row[length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1])
    new &= inside
    new[1:] |= inside[1:] & ~inside[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return None
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    a = anchor[first]
    doc = row[first]
    start, end = np.maximum(first - 1, at[doc]), np.minimum(last + length + 1, at[doc + 1])
    stretch = [mix(x + (a - start).astype(U64)) for x in digests(lanes(data), data, start, end, _SEEDS)]
    return doc, a - at[doc], first - at[doc], last - at[doc], h[a], *stretch


def _windows(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple[int, int]]]:
    """Texts in runs of about SCAN bytes, and longer ones in windows: first row, the window's place, bytes, offsets, and which anchors count.

    Windows overlap so far that an anchor has all its starts in the window where it counts.
    """
    for r, _, data, at in chunks(column, SCAN):
        if len(data) <= 2 * SCAN:
            yield r, 0, data, at, (0, len(data))
            continue
        for low in range(0, len(data), SCAN):
            place = max(0, low - length)
            part = data[place : low + SCAN + length + 1]
            yield r, place, part, np.array([0, len(part)]), (low - place, low - place + SCAN)


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY)
                for r, place, data, at, (from_, to) in _windows(batch.column("text"), length):
                    if found := anchors(data, at, length, k):
                        if len(at) == 2:  # one text: maybe a window of it
                            counts = (found[1] >= from_) & (found[1] < to)
                            found = tuple(x[counts] for x in found)
                        doc, a, low, high, core, ext, ext2 = found
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x) for x in (ids[r + doc], twins[r + doc], *((x + place).astype(np.int32) for x in (a, low, high)), core.view(np.int64), ext.view(np.int64), ext2.view(np.int64))],
                            [*_KEY, "anchor", "low", "high", "core", "ext", "ext2"],
                        )

    return run


def _ranked(runs: DataFrame, name: str) -> DataFrame:
    """The runs whose core isn't unique, with `whole` (their stretch isn't either) and `go` (they need a finer round).

    Of a repeated stretch one run goes on as a witness if its core also has runs that are still open.
    """
    spark = runs.sparkSession
    cores = scratch.saved(runs.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-cores")
    scratch.release(spark)
    some = scratch.saved(runs.join(cores.select("core"), "core", "left_semi").select(runs.columns), f"{name}-some")
    scratch.drop(runs)
    scratch.release(spark)
    place = F.min(F.struct(*_KEY, "low"))
    whole = ["core", "ext", "ext2"]
    pairs = scratch.saved(some.where("ext is not null").groupBy(*whole).agg(F.count("*").alias("m"), place.alias("one")).where("m > 1"), f"{name}-pairs")
    scratch.release(spark)
    still = cores.join(pairs.groupBy("core").agg(F.sum("m").alias("m")), "core").where("n > m").select("core", F.lit(True).alias("open"))
    pairs2 = scratch.saved(pairs.join(still, "core", "left").select(*whole, "one", F.coalesce("open", F.lit(False)).alias("open"), F.lit(True).alias("again")), f"{name}-pairs2")
    scratch.drop(pairs)
    out = some.join(pairs2, whole, "left")
    witness = F.col("open") & (F.struct(*_KEY, "low") == F.col("one"))
    out = out.select(*runs.columns, F.coalesce("again", F.lit(False)).alias("whole"), F.coalesce(witness, F.lit(False)).alias("witness"))
    out = scratch.saved(out.withColumn("go", ~F.col("whole") | F.col("witness")).drop("witness", *whole), f"{name}-ranked")
    for table in (cores, some, pairs2):
        scratch.drop(table)
    scratch.release(spark)
    return out


def _stretches(length: int, block: int):
    """The bytes around the pending anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY)
            lists = batch.column("runs")
            many = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            anchor, low, high = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            base = 0
            for r0, r1, data, at in chunks(batch.column("text"), SCAN):
                rows = np.repeat(np.arange(r1 - r0), many[r0:r1])
                for c in range(0, len(rows), CUT):
                    row = rows[c : c + CUT]
                    a, lo, hi = (x[base + c : base + c + len(row)] for x in (anchor, low, high))
                    size = np.diff(at)[row]
                    start = np.maximum(a - ((a - lo) // block * block + block - 1), 0)
                    end = np.minimum(a - (a - hi) // block * block + length, size)
                    got = gather(data, at[row] + start, end - start)
                    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (ids[r0 + row], twins[r0 + row], *(x.astype(np.int32) for x in (a, lo, hi, start)))]
                        + [pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(got))])],
                        [*_KEY, "anchor", "low", "high", "start", "bytes"],
                    )
                base += len(rows)

    return run


def _block_rows(length: int, block: int):
    """Cuts runs (anchor, low..high) into blocks of starts that lie evenly from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_KEY, "anchor", "low", "high", "core", "ext", "ext2", "start", "bytes"]
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, twins, anchor, low, high, start = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_KEY, "anchor", "low", "high", "start"))
                for r0, r1, data, at in chunks(batch.column("bytes"), SCAN):
                    a, s = anchor[r0:r1], start[r0:r1]
                    least, most = (a - high[r0:r1]) // block, (a - low[r0:r1]) // block
                    many = most - least + 1
                    row = np.repeat(np.arange(r1 - r0), many)
                    j = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + least[row]
                    last = a[row] - j * block
                    first = last - block + 1
                    there = at[row] - s[row]
                    stop = s[row] + np.diff(at)[row]
                    prefix = rolling().prefix(data)
                    core = mix(rolling().spans(prefix, there + last, there + first + length) ^ mix((j * block + 1).astype(U64)))
                    fits = (first >= s[row]) & (last + length <= stop)
                    lo, hi = there + np.maximum(first, s[row]), there + np.minimum(last + length, stop)
                    ext, ext2 = digests(lanes(data), data, lo, hi, _SEEDS)
                    lo_p, hi_p = np.maximum(first, low[r0:r1][row]), np.minimum(last, high[r0:r1][row])
                    columns = [pa.array(x) for x in (ids[r0 + row], twins[r0 + row], a[row].astype(np.int32), lo_p.astype(np.int32), hi_p.astype(np.int32), core.view(np.int64))]
                    columns += [pa.array(x.view(np.int64), mask=~fits) for x in (ext, ext2)]
                    if block > 1:
                        columns += [pa.array(s[row].astype(np.int32)), batch.column("bytes").take(pa.array(r0 + row))]
                    yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def repeats(texts: DataFrame, length: int = 200, k: int = 72) -> DataFrame:
    """(id, twin, low, high) of keyed texts: starts low..high of strings of `length` bytes that also start elsewhere."""
    key, digest = "id long, twin long", "core long, ext long, ext2 long"
    ranked = _ranked(scratch.saved(texts.mapInArrow(_anchor_rows(length, k), f"{key}, anchor int, low int, high int, {digest}"), "anchors"), "anchors")
    done = [ranked.where("whole").select(*_KEY, "low", "high")]
    pending = ranked.where("go").groupBy(*_KEY).agg(F.collect_set(F.struct("anchor", "low", "high")).alias("runs"))
    runs = scratch.saved(texts.join(pending, _KEY).mapInArrow(_stretches(length, ROUNDS[0]), f"{key}, anchor int, low int, high int, start int, bytes binary"), "stretches")
    scratch.release(texts.sparkSession)
    for block in ROUNDS:
        schema = f"{key}, anchor int, low int, high int, {digest}" + (", start int, bytes binary" if block > 1 else "")
        cut = scratch.saved(runs.mapInArrow(_block_rows(length, block), schema), f"runs{block}")
        scratch.drop(runs)
        ranked = _ranked(cut, f"runs{block}")
        done.append(ranked.where("whole").select(*_KEY, "low", "high"))
        runs = scratch.saved(ranked.where("go").select(*_KEY, "anchor", "low", "high", "start", "bytes"), "runs") if block > 1 else None
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def covered(low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes [start, end) under strings that start at low..high."""
    order = np.argsort(low, kind="stable")
    start, end = low[order], np.maximum.accumulate(high[order] + length)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _kept(text: memoryview, low: np.ndarray, high: np.ndarray, length: int, whole_chars: bool):
    """What stays of a text, removed bytes and removed runs."""
    if not len(low):
        return bytes(text), 0, 0
    start, end = covered(low.astype(np.int64), high.astype(np.int64), length)
    raw = np.frombuffer(text, np.uint8)
    if whole_chars:  # removed runs shrink to whole characters
        tail = (raw & 0xC0) == 0x80
        for i in range(len(start)):
            while start[i] < end[i] and tail[start[i]]:
                start[i] += 1
            while end[i] > start[i] and end[i] < len(raw) and tail[end[i]]:
                end[i] -= 1
    edges = np.append(start, len(raw))
    begins = np.append(0, end)
    return b"".join(bytes(text[b:e]) for b, e in zip(begins, edges, strict=True)), int((end - start).sum()), int((end > start).sum())


def _free(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _joined(docs: DataFrame, length: int, k: int) -> tuple[DataFrame, str]:
    """The rows, all columns, with a further one that lists their repeated starts as (low, high); its name."""
    found = repeats(keyed(docs), length, k).groupBy(*_KEY).agg(F.collect_set(F.struct("low", "high")).alias("starts"))
    key = [_free(f"repeats {c}", docs.columns) for c in (*_KEY, "starts")]
    rows = docs.withColumns({key[0]: F.coalesce("doc_id", F.lit(0)).cast("long"), key[1]: F.xxhash64("text")})
    return rows.join(found.toDF(*key), key[:2], "left").select(*docs.columns, key[2]), key[2]


def _rows(batch: pa.RecordBatch, starts: str, length: int, whole_chars: bool):
    text = batch.column(batch.schema.get_field_index("text"))
    for t, own in zip(text, batch.column(starts), strict=True):
        view = memoryview(t.as_buffer()) if t.is_valid else memoryview(b"")
        low, high = (own.values.field(i).to_numpy() for i in range(2)) if own.is_valid else [np.zeros(0, np.int32)] * 2
        yield (len(view), *_kept(view, low, high, length, whole_chars))


def report(docs: DataFrame, length: int = 200, k: int = 72) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, and SHA-256 of what is left.

    Null and empty texts have no bytes and lose none; texts shorter than `length`
    lose none; every copy of a repeated passage goes, the first one too.  Rows
    that repeat, have one id with different texts, or have no id count like any
    other and are reported one by one.
    """
    joined, starts = _joined(docs.select("doc_id", "text"), length, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_rows(batch, starts, length, False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in rows], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = 200, k: int = 72) -> DataFrame:
    """The documents, all columns, without their repeated passages (in whole characters); null texts stay null.

    A column n_chars, if there is one, gets the new number of characters.  Rows that
    repeat are copies of each other, so both lose what is long enough; an empty table
    gives no rows.
    """
    (joined, starts), columns = _joined(docs, length, k), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [x[1].decode() if t.is_valid else None for x, t in zip(_rows(batch, starts, length, True), batch.column(at), strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(columns)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
