"""Packing with little padding: first-fit decreasing in random groups of documents, then gaps filled by cuts.

Tokenised documents longer than a sequence give full sequences and a rest.  Rests
are dealt to groups at random, each of bounded size however many documents there
are.  A group is packed by itself: rests in descending length go to the first
sequence with enough room, which a tournament tree over the sequences' rooms finds
in logarithmic time.  Then the emptiest sequences are taken apart and their pieces,
cut where needed, fill the gaps of the others; what is left of the group, less
than one sequence, is cut into powers of two, which need no padding.

Only lengths and checksums travel to the groups.  The ids stay where they were
written, and only those of pieces that were cut are looked up again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm import scratch
from loomrank.llm.bytescan import strings
from loomrank.llm.packing import token_encoder

#: Documents of a group, about.
GROUP = 1 << 15
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, nth long, rest long"
_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Tournament:
    """Sequences in the order they were opened, with the most room of every subtree: the first with enough room is found from the top."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, length: int) -> int:
        """Places a piece in the first sequence with enough room."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        sequence = at - self.leaves
        room[at] -= length
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return sequence


def first_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The positions of the pieces in each sequence, by first-fit decreasing."""
    tree = Tournament(len(lengths), capacity)
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        sequence = tree.put(lengths[i])
        if sequence == len(out):
            out.append([])
        out[sequence].append(i)
    return out


def filled(sequences: list[list[int]], lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """(piece, from, how many) of each sequence once gaps are filled: all are full or hold a power of two."""
    used = [sum(lengths[i] for i in s) for s in sequences]
    order = sorted(range(len(sequences)), key=lambda s: -used[s])  # the emptiest give
    whole = sum(used) // capacity
    out = [[(i, 0, lengths[i]) for i in sequences[s]] for s in order[:whole]]
    # the shortest last, so that few pieces are cut
    given = [(i, 0, lengths[i]) for s in order[whole:] for i in sorted(sequences[s], key=lambda i: lengths[i])]

    def take(n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            i, start, length = given.pop()
            some = min(n, length)
            got.append((i, start, some))
            if some < length:
                given.append((i, start + some, length - some))
            n -= some
        return got

    for s, rank in zip(out, order[:whole], strict=True):
        s += take(capacity - used[rank])
    rest = sum(x[2] for x in given)
    out += [take(1 << bit) for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
    return out


def _grouped(capacity: int, cut: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("nth").to_pydict()  # the same result however rows arrive
        lengths = rows["length"]
        packed = first_fit(lengths, capacity)
        placed = filled(packed, lengths, capacity) if cut else [[(i, 0, lengths[i]) for i in s] for s in packed]
        out = []
        for sequence, pieces in enumerate(placed):
            offset, number = 0, ((key[0].as_py() << 32 | sequence) << 1) + 1  # even numbers are for full ones
            for i, start, n in pieces:
                crc = rows["ids_crc32"][i] if n == lengths[i] else None
                out.append((rows["doc_id"][i], rows["start"][i] + start, n, crc, rows["doc_tokens"][i], number, offset, rows["nth"][i], start))
                offset += n
        columns = list(zip(*out, strict=True)) if out else [()] * 9
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _PLACED.split(", ")])

    return run


def _tokenised(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(path)
        for batch in batches:
            data, at = strings(batch.column(1))
            wide = np.searchsorted(np.flatnonzero(data >= 0xF0), at)  # characters beyond the basic plane before each text
            rows = []
            for doc, text, many in zip(batch.column(0).to_pylist(), batch.column(1), np.diff(wide).tolist(), strict=True):
                ids = np.append(encoder.ids(text.as_py() or "", not many), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity].tobytes()
                    rows.append((doc, start, len(own) // 4, zlib.crc32(own), len(ids), own))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def _cut(names: list[str]):
    """Checksums (and ids) of pieces that were cut out of a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, crcs = [], []
            for whole, start, n in zip(batch.column("ids"), batch.column("rest").to_pylist(), batch.column("length").to_pylist(), strict=True):
                own = whole.as_buffer()[4 * start : 4 * (start + n)]
                crcs.append(zlib.crc32(own))
                ids.append(own.to_pybytes())
            made = {"ids_crc32": pa.array(crcs, pa.int64()), "ids": pa.array(ids, pa.binary())}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in names], names)

    return run


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False, cut: bool = True, group: int = GROUP, seed: int = 0) -> DataFrame:
    """One row per piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, as little-endian 32-bit numbers).

    Null and empty texts are the end id alone.  Documents that repeat are packed as
    often as they occur, whether or not they have ids; an empty table gives no rows.
    cut: fill gaps by cutting; without it rests stay whole and gaps are padding.
    """
    tokens = docs.select("doc_id", "text").mapInArrow(_tokenised(path, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    tokens = scratch.saved(tokens.withColumn("nth", F.monotonically_increasing_id()), "tokens")  # numbered once: equal rows are told apart
    names = _OUT + (["ids"] if keep_ids else [])
    full = tokens.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("nth") * 2, "offset": F.lit(0).cast("long")}).select(*names)
    rests = tokens.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group))
    dealt = rests.select(F.pmod(F.xxhash64("nth", F.lit(seed)), F.lit(groups)).alias("grp"), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth")
    placed = scratch.saved(dealt.groupBy("grp").applyInArrow(_grouped(capacity, cut), _PLACED), "placed")
    short = placed.where("ids_crc32 IS NULL")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if keep_ids else "")
    pieces = short.join(rests.select("nth", "ids"), "nth").mapInArrow(_cut(names), schema)
    kept = placed.where("ids_crc32 IS NOT NULL")
    if keep_ids:
        kept = kept.join(rests.select("nth", "ids"), "nth")
    return full.unionByName(kept.select(*names)).unionByName(pieces)


def padding(total: int, capacity: int) -> int:
    """What a sequence of so many tokens is padded by: nothing at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total
