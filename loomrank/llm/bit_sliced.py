"""Exact top-k by inner product over bit-sliced quantised vectors.

A block of rows is stored by attribute and binary digit: one bitmap over the rows
for each.  A query's score is a sum of attributes times its integer components,
so it is the sum of shifted slices (inverted ones for negative components), added
for all rows at once by carry-save adders on bitmaps.  The DROP least significant
slices stay out of this sum, which leaves every row an error within known bounds.
From the most significant digit of the sums downward the k-th largest is found,
then all rows that may still reach it; those boundary rows get exact scores.

Rows with components of LARGE and more, and queries whose sums could leave 64 bits,
are scored in Python's integers instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.llm import vectors

DROP = 3
#: Quantised components that stay out of the slices, sums of magnitudes that fit them, and what a score has to fit.
LARGE, NARROW, LONG = 1 << 32, 1 << 52, 1 << 63


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers in double precision, exact whatever their size."""
    return np.floor(scale * x)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), bool)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class Index:
    """The slices of a block: digits[b, d] is the bitmap of digit b of attribute d above its least value."""

    def __init__(self, values: np.ndarray, drop: int = DROP):
        self.values, self.n = values, len(values)
        self.least = values.min(0)
        above = values - self.least
        self.width = max(1, int(above.max(initial=0)).bit_length())
        self.drop = min(drop, self.width - 1)
        digits = range(self.drop, self.width)
        self.digits = np.stack([_packed((above.T >> b) & 1 > 0) for b in digits], axis=1)  # attribute, digit, word
        self.full = _packed(np.ones(self.n, bool))

    def sums(self, query: np.ndarray) -> np.ndarray:
        """Slices of the sum over attributes of |component| times its (inverted) value without the dropped digits."""
        size = np.abs(query)
        terms: list[np.ndarray] = []  # pairs in carry-save form, all aligned to the sum's lowest digit
        width = self.digits.shape[1] + int(size.sum()).bit_length() + 1
        flipped = query < 0
        for j in range(int(size.max(initial=0)).bit_length()):
            chosen = np.flatnonzero((size >> j) & 1)
            if not len(chosen):
                continue
            stack = self.digits[chosen]
            turned = flipped[chosen]
            stack[turned] = ~stack[turned]
            for x in _saved(stack):
                out = np.zeros((width, x.shape[1]), np.uint64)
                out[j : j + x.shape[0]] = x[: width - j]
                terms.append(out)
        if not terms:
            return np.zeros((1, len(self.full)), np.uint64)
        left = _saved(np.stack(terms), width)
        return left[0] if len(left) == 1 else _added(left[0], left[1])

    def offset(self, query: np.ndarray) -> tuple[int, int]:
        """What turns a sum (in units of the lowest kept digit) into a score: score = offset + unit * sum + an error from 0 to the second value."""
        top = (1 << self.width) - 1
        rest = (1 << self.drop) - 1
        base = int((query * np.where(query >= 0, self.least, self.least + top)).sum())
        return base, int(np.abs(query).sum()) * rest

    def top(self, query: np.ndarray, k: int, without: np.ndarray | None = None) -> np.ndarray:
        """Rows among which the k best are, ties included; the rows `without` take no part."""
        full = self.full
        if without is not None and len(without):
            out = np.ones(self.n, bool)
            out[without] = False
            full = _packed(out)
        if int(np.bitwise_count(full).sum()) <= k:
            return np.flatnonzero(np.unpackbits(full.view(np.uint8), bitorder="little"))
        slices = self.sums(query)
        every, sure, value = full.copy(), np.zeros_like(full), 0
        need = k
        for s in slices[::-1]:  # every: rows that agree with the k-th largest so far
            ones = every & s
            count = int(np.bitwise_count(ones).sum())
            value <<= 1
            if count >= need:
                every, value = ones, value | 1
            else:
                sure |= ones
                need -= count
                every &= ~s
        _, error = self.offset(query)
        least = max(0, value - (error >> self.drop) - 1)
        return np.flatnonzero(np.unpackbits(_at_least(slices, least, full).view(np.uint8), bitorder="little"))


def _saved(stack: np.ndarray, width: int | None = None) -> list[np.ndarray]:
    """Numbers (term, digit, word) added three to two until at most two are left."""
    while len(stack) > 2:
        n = len(stack) // 3
        a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
        half = a ^ b
        digits = stack.shape[1] + 1 if width is None else width
        out = np.zeros((2 * n + len(stack) - 3 * n, digits, stack.shape[2]), np.uint64)
        out[:n, : stack.shape[1]] = half ^ c
        carry = (a & b) | (half & c)
        out[n : 2 * n, 1 : 1 + carry.shape[1]] = carry[:, : digits - 1]
        out[2 * n :, : stack.shape[1]] = stack[3 * n :]
        stack = out
    return list(stack)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    carry = np.zeros(a.shape[1], np.uint64)
    for i in range(len(a)):
        half = a[i] ^ b[i]
        out[i] = half ^ carry
        carry = (a[i] & b[i]) | (half & carry)
    return out


def _at_least(slices: np.ndarray, value: int, full: np.ndarray) -> np.ndarray:
    above, same = np.zeros_like(full), full.copy()
    for i in range(len(slices) - 1, -1, -1):
        if value >> i & 1:
            same &= slices[i]
        else:
            above |= same & slices[i]
            same &= ~slices[i]
    return above | same


def _wide(values: np.ndarray, query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Scores of some rows by whole numbers of any size."""
    q = [int(x) for x in query]
    return [sum(a * b for a, b in zip(map(int, values[i]), q, strict=True)) for i in rows]


def _found(scale: float, k: int):
    def run(ids: np.ndarray, rows: np.ndarray, names: np.ndarray, queries: np.ndarray):
        values, asked = quantised(rows, scale), quantised(queries, scale)
        large = np.abs(values).max(1, initial=0) >= LARGE
        small, rest = np.flatnonzero(~large), np.flatnonzero(large)
        whole = values[small].astype(np.int64)
        index = Index(whole) if len(small) else None
        narrow = np.abs(asked) @ (np.abs(whole).max(0, initial=0) + 1.0) < NARROW
        order = np.argsort(ids[small], kind="stable")
        first, last = (np.searchsorted(ids[small][order], names, side) for side in ("left", "right"))
        out = []
        for i, query in enumerate(asked):
            own = order[first[i] : last[i]]
            if narrow[i] and index:
                may = index.top(query.astype(np.int64), k, own)
                score = (whole[may] @ query.astype(np.int64)).tolist()
                may = small[may]
            else:
                may = np.delete(small, own)
                score = _wide(values, query, may)
            more = rest[ids[rest] != names[i]]
            may, score = np.concatenate([may, more]), score + _wide(values, query, more)
            best = sorted(range(len(may)), key=lambda j: (-score[j], ids[may[j]]))[:k]  # noqa: B023
            if any(not -LONG <= score[j] < LONG for j in best):
                raise OverflowError("an inner product among the largest doesn't fit a long")
            out.append((np.full(len(best), i), ids[may[best]], np.array([score[j] for j in best], np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x), ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part; a
    null vec_id neither.  A result's score that doesn't fit a long is an error.
    Shorter vectors count as filled with zeros.  All rows with the query's vec_id
    are its own; of a query id's vectors the least is asked.
    """
    return vectors.searched(embeddings, is_query, _found(scale, k), "long", F.desc("score"), k, lambda x: np.ones(len(x), bool))
