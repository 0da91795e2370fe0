"""Approximate nearest neighbours by a forest of hash prefixes.

Every block of rows is indexed whole.  A tree is a sorted array of long hash
strings, one bit per random hyperplane through the block's centre; rows with a
common prefix are neighbours in the array.  A query descends each array to its
longest matching prefix, then ascends all trees together, one bit at a time, and
takes the rows under the shortened prefixes until it has enough different
candidates.  Those are ranked by their exact distance.

How many are enough is measured on the block: for PROBES of its own rows the true
nearest rows are found by brute force, and the count is set so that ascending
that far would have found RECALL of them.  On data without structure this is a
large part of the block, on clustered data a small one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.llm import vectors

TREES, BITS = 48, 32
PROBES, RECALL = 24, 0.97


class Forest:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, trees: int = TREES, bits: int = BITS, seed: int = 5):
        order = np.lexsort((ids, *rows.T[::-1]))
        rows, ids = rows[order], ids[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(1))  # equal vectors are one entry with all their ids
        self.first = np.append(np.flatnonzero(new), len(ids))
        self.ids, self.names, self.rows, self.bits = ids, np.sort(ids), rows[new], bits
        self.centre = self.rows.mean(0)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.planes = rng.normal(size=(trees, rows.shape[1], bits))
        strings = self.hashed(self.rows)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        self.enough = self._measured(strings, k)

    def hashed(self, x: np.ndarray) -> np.ndarray:
        """A string of bits for each tree and row."""
        shift = np.arange(self.bits - 1, -1, -1).astype(np.uint64)
        out = np.empty((len(self.planes), len(x)), np.uint64)
        for t, planes in enumerate(self.planes):
            out[t] = (((x - self.centre) @ planes > 0).astype(np.uint64) << shift).sum(1)
        return out

    def _depth(self, strings: np.ndarray, one: np.ndarray) -> np.ndarray:
        """The longest prefix that each row shares with a string in any tree."""
        differ = (strings ^ one[:, None]).min(0)
        return self.bits - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1).astype(float))) + 1, 0).astype(np.int64)

    def _measured(self, strings: np.ndarray, k: int) -> int:
        n = len(self.rows)
        if n <= 4 * k:
            return n
        needed = []
        for p in np.linspace(0, n - 1, PROBES).astype(int):
            far = ((self.rows - self.rows[p]) ** 2).sum(1)
            near = np.argpartition(far, k)[: k + 1]
            depth = self._depth(strings, strings[:, p])
            at_least = np.cumsum(np.bincount(depth, minlength=self.bits + 1)[::-1])[::-1]
            needed += at_least[depth[near[near != p]]].tolist()
        return int(min(n, max(4 * k, np.quantile(needed, RECALL))))

    def candidates(self, one: np.ndarray) -> np.ndarray:
        """Entries for a query's strings: synchronous ascent from the longest matches."""
        trees, n = self.sorted.shape
        if self.enough >= n:
            return np.arange(n)
        seen, count, out = np.zeros(n, bool), 0, []
        low = np.zeros(trees, np.int64)
        high = np.zeros(trees, np.int64)
        for t in range(trees):
            low[t] = high[t] = np.searchsorted(self.sorted[t], one[t])
        for depth in range(self.bits, -1, -1):
            shift = np.uint64(self.bits - depth)
            start = (one >> shift) << shift
            stop = start + (np.uint64(1) << shift)
            for t in range(trees):
                array = self.sorted[t]
                a, b = np.searchsorted(array, start[t]), np.searchsorted(array, stop[t])
                for x in (self.order[t, a : low[t]], self.order[t, high[t] : b]):
                    if len(x):
                        x = x[~seen[x]]
                        seen[x] = True
                        out.append(x)
                        count += len(x)
                low[t], high[t] = min(a, low[t]), max(b, high[t])
            if count >= self.enough:
                break
        return np.concatenate(out)

    def nearest(self, query: np.ndarray, one: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest candidates other than `own`, ties to the smaller id."""
        more = k + int(np.searchsorted(self.names, own, "right") - np.searchsorted(self.names, own, "left"))  # its own rows go afterwards
        found = self.candidates(one)
        far = np.sqrt(((self.rows[found] - query) ** 2).sum(1))
        if len(found) > more + 1:
            keep = far <= np.partition(far, more)[more]
            found, far = found[keep], far[keep]
        size = np.minimum(self.first[found + 1] - self.first[found], more)
        at = np.repeat(self.first[found] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ids, far = self.ids[at], np.repeat(far, size)
        best = np.lexsort((ids, far))
        best = best[ids[best] != own][:k]
        return ids[best], far[best]


def _found(k: int):
    def run(ids: np.ndarray, rows: np.ndarray, names: np.ndarray, queries: np.ndarray):
        forest = Forest(ids, rows, k)
        strings = forest.hashed(queries)
        out = []
        for i, query in enumerate(queries):
            found, far = forest.nearest(query, strings[:, i], names[i], k)
            out.append((np.full(len(found), i), found, far))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return run


def neighbours(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, ties to the smaller vec_id.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; a null vec_id neither.  Shorter vectors count as filled with zeros.  All
    rows with the query's vec_id are its own; of a query id's vectors the least is asked.
    """
    return vectors.searched(embeddings, is_query, _found(k), "double", F.asc("score"), k, lambda x: (x != 0).any(1))
