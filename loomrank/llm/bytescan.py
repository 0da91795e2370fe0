"""Vectorised scanning of UTF-8 text in Arrow batches.

Every function works on the raw bytes of a slice of a string column, so that a
document costs a few NumPy passes and never a Python loop over characters.

Rolling fingerprints are polynomial sums modulo 2**64 over a random byte table.  With
an odd base the powers are invertible, which turns the fingerprint of any substring
into one subtraction and one multiplication of prefix sums.  Some texts share them
(Thue-Morse words), so they only ever rule things out.  What decides that two strings
are equal is `digests`, which mixes eight bytes at a time and has no such structure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; temporaries take about sixty times as much.
CHUNK = 1 << 20


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


class Rolling:
    """Fingerprints of substrings; equal strings have equal fingerprints anywhere."""

    def __init__(self, seed: int, base: int):
        self.table, self.base, self.inverse = _table(seed), base | 1, _inverse(base | 1)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, CHUNK + 1)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    out = np.full(size, U64(b), U64)
                    out[0] = 1
                    setattr(self, name, np.multiply.accumulate(out))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than the data."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, U64)
        terms = self.table[data]
        terms *= self.down[: len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.up[start]

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of all k-grams; the i-th starts at i."""
        n = len(prefix) - k
        return (prefix[k:] - prefix[:n]) * self.up[:n] if n > 0 else np.zeros(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1)).copy().view("<u8").reshape(-1)


#: The lowest bytes of a number, by their count.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)
#: Bytes of a string beyond which its digest comes from hashlib: a step for all strings a lane would run for few.
LONG = 1 << 11


def digests(lane: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """A 64-bit hash per seed of every slice; lane: lanes(data).  Independent seeds together make a wider one."""
    size = end - start
    out = [mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) for seed in seeds]
    short = size <= LONG
    order = np.argsort(-np.where(short, size, 0), kind="stable")
    sizes, starts = np.where(short, size, 0)[order], start[order]
    steps = -(-int(sizes[0]) // 8) if len(sizes) else 0
    state = [x[order] for x in out]
    for i in range(steps):
        n = int(np.searchsorted(-sizes, -8 * i, "left"))
        part = lane[starts[:n] + 8 * i]
        part &= _MASK[np.minimum(sizes[:n] - 8 * i, 8)]
        for x in state:
            x[:n] = mix(x[:n] ^ part) + U64(0x9E3779B97F4A7C15)
    for x, y in zip(out, state, strict=True):
        x[order] = y
    for i in np.flatnonzero(~short).tolist():
        found = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8 * len(seeds)).digest()
        for x, v in zip(out, np.frombuffer(found, "<u8"), strict=True):
            x[i] ^= v
    return out


FIRST, SECOND = (0x5DEECE66D, 0x9E3779B97F4A7C15), (0x2545F491, 0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes each: first row, end row, bytes, offsets from 0.

    One longer text makes a run of its own.
    """
    data, at = strings(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, at: np.ndarray, of: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes `of` (all but ASCII white space): starts, ends, and each text's first run (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = of[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes (or other items) of many slices, one after another."""
    total = int(length.sum())
    if not total:
        return data[:0]
    out = np.cumsum(length) - length
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(start - out, length)
    return data[index]
