"""Packing of tokenised documents into sequences of fixed capacity.

The lengths of all pieces form a histogram with at most `capacity` bars, whatever
the number of documents.  On it the driver solves the configuration linear
program (how often each way to fill a sequence is used) by multiplicative
weights: every length has a weight that falls as it gets covered, a knapsack
dynamic program finds the filling of the highest weight, and that filling's use
goes up by a step, until each length is covered.  The weights are a solution of the
dual program, so they say how far the plan can be from the fewest sequences.  The
uses are scaled and rounded down; what is left over, few pieces however many
documents there are, is packed by filling each sequence around its largest piece as
full as it goes, or by best fit decreasing, whichever takes fewer sequences.

Histograms with many lengths have so many nearly full fillings that a first attempt
which only takes those, and leaves the last pieces to the rounding, mostly comes
within CLOSE of the tokens' own bound; the program runs to its end where it doesn't.  The plan is a bounded list of fillings with counts;
pieces find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm import scratch
from loomrank.llm.bytescan import strings

#: Multiplicative-weights steps, and the share of the scarcest length that one step covers.
STEPS, SHARE = 2000, 0.25
#: The least filled share of a filling, and the weight rules (decay, lean) that are tried.
FULL, RULES = 0.995, ((0.2, 0.1), (0.1, 1.0))
#: The share above the tokens' own bound that ends the search, the covering program's steps (more where few don't do), and how fast its weights fall.
CLOSE, COVERING, RATE = 0.0005, (300, 3000), 0.5
log = logging.getLogger(__name__)
_PIECE = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
_encoders: dict = {}

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


class _Encoder:
    """Byte-level BPE ids of a tokenizers file, as its own library gives them.

    The file's vocabulary runs on a faster engine that gives the same ids on texts
    of the basic plane; texts with other characters, and texts that hold one of the
    file's special tokens as a string, go through the library itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabets show these bytes as themselves
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"] for t in file["added_tokens"]}
        self.special = sorted(special)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str, plain: bool) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if plain and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.exact is None:  # few texts need it, so most workers never hold it
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def token_encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces, and a shorter one first if needed."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenised(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = token_encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, at = strings(batch.column(1))
            wide = np.searchsorted(np.flatnonzero(data >= 0xF0), at)  # characters beyond the basic plane before each text
            rows, names, tokens = [], batch.column(0).to_pylist(), []
            for doc, text, many in zip(names, batch.column(1), np.diff(wide).tolist(), strict=True):
                ids = np.append(encoder.ids(text.as_py() or "", not many), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((part, doc, k, start, length, zlib.crc32(own), seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        tokens.append(own.astype(np.int32))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "nth"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def best_filling(weight: np.ndarray, capacity: int) -> Filling:
    """The filling of the highest total weight (unbounded knapsack over lengths)."""
    lengths = np.flatnonzero(weight > 0)
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    value = weight[lengths]
    stop = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = stop[c]
        if n:
            total = best[c - lengths[:n]] + value[:n]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], pick[c] = total[k], lengths[k]
    count: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c]:
            count[int(pick[c])] = count.get(int(pick[c]), 0) + 1
            c -= int(pick[c])
        else:
            c -= 1
    return tuple(sorted(count.items(), reverse=True))


def covered(counts: np.ndarray, capacity: int, steps: int = COVERING[-1], rate: float = RATE) -> tuple[dict[Filling, float], float]:
    """Fillings with uses that cover every length, and a lower bound of the sequences that any packing takes.

    A step uses the filling of the highest weight until the scarcest of its lengths is
    covered a little more; a covered length's weight falls by exp(-rate) for each time
    over.  The uses cover all lengths once they are divided by the least coverage.
    Whatever the weights, no filling is worth more than the best one, so all pieces'
    weight over the best filling's is a bound.
    """
    some = np.flatnonzero(counts)
    n = counts[some].astype(float)
    cover = np.zeros(len(some))
    use: dict[Filling, float] = {}
    weight, bound = np.zeros(capacity + 1), float((counts * np.arange(capacity + 1)).sum()) / capacity
    share = some / capacity
    place = np.full(capacity + 1, -1)
    place[some] = np.arange(len(some))
    best: tuple[float, dict[Filling, float]] = (math.inf, {})
    for step in range(1, steps + 1):
        # prices per piece: the tokens' share, and what is still missing compared with the others
        weight[some] = share * np.exp(-rate * (cover - cover.min()))
        filling = best_filling(weight, capacity)
        value = sum(weight[x] * k for x, k in filling)
        bound = max(bound, float((weight[some] * n).sum()) / value)
        amount = 0.05 * min(n[place[x]] / k for x, k in filling)
        use[filling] = use.get(filling, 0.0) + amount
        for x, k in filling:
            cover[place[x]] += amount * k / n[place[x]]
        least = cover.min()
        if least > 0 and step % 25 == 0:
            total = sum(use.values()) / least
            if total < best[0]:
                best = total, {f: u / least for f, u in use.items()}
            if total <= bound * (1 + CLOSE):
                break
    return best[1] or {f: u / max(cover.min(), 1e-9) for f, u in use.items()}, bound


def relaxed(counts: np.ndarray, capacity: int, decay: float = 0.2, lean: float = 0.1, steps: int = STEPS) -> dict[Filling, float]:
    """Fillings with their uses, an approximate solution of the configuration LP.

    A length's weight starts at its share of a sequence to the power 1 + lean and
    decays with the part of it that is covered.  It ends when the best filling
    leaves more than FULL allows unused: what is still uncovered is for rounding,
    and where that is too much, covered() decides.
    """
    n = counts.astype(float)
    some = counts > 0
    share = np.arange(capacity + 1) / capacity
    use: dict[Filling, float] = {}
    covered = np.zeros(capacity + 1)
    for _ in range(steps):
        ratio = np.where(some, covered / np.maximum(n, 1), 1)
        weight = np.where(some & (ratio < 1 - 1e-9), share ** (1 + lean) * np.exp(-decay * ratio), 0)
        filling = best_filling(weight, capacity)
        if sum(x * k for x, k in filling) < FULL * capacity:
            break
        step = min(max(SHARE * n[x], 1) / k for x, k in filling)
        step = max(min(step, min((n[x] - covered[x]) / k for x, k in filling)), 0.25)
        use[filling] = use.get(filling, 0.0) + step
        for x, k in filling:
            covered[x] += step * k
    return use


def _fullest(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Fills each sequence around its largest piece as full as the other pieces allow."""
    left, out = counts.copy(), []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        room = capacity - top
        source = np.full(room + 1, -1, np.int64)  # the length that first reached each sum
        source[0] = 0
        for x in np.flatnonzero(left[: room + 1])[::-1]:
            for _ in range(int(min(left[x], room // x))):
                old = source[: room + 1 - x] >= 0
                fresh = old & (source[x:] < 0)
                if not fresh.any():
                    break
                source[x:][fresh] = x
            if source[room] >= 0:
                break
        at = int(np.flatnonzero(source >= 0)[-1])
        count = {top: 1}
        while at > 0:
            x = int(source[at])
            count[x] = count.get(x, 0) + 1
            at -= x
        left[top] += 1
        times = min(int(left[x]) // k for x, k in count.items())
        if times < 1:  # a sum that took one length more often than there are pieces
            count = {x: min(k, int(left[x])) for x, k in count.items()}
            times = 1
        for x, k in count.items():
            left[x] -= times * k
        out.append((tuple(sorted(count.items(), reverse=True)), times))
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing on a histogram: groups of sequences with the same filling move together."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    free = np.zeros(capacity + 1, bool)
    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            fits = np.flatnonzero(free[x:])
            if len(fits):
                room = x + int(fits[0])
                filling, times = rooms[room].pop()
                free[room] = bool(rooms[room])
                used = min(n, times)
                if times > used:
                    rooms[room].append((filling, times - used))
                    free[room] = True
            else:
                room, filling, used = capacity, {}, n
            n -= used
            rooms.setdefault(room - x, []).append((filling | {x: filling.get(x, 0) + 1}, used))
            free[room - x] = room > x
    return [(tuple(sorted(f.items(), reverse=True)), t) for group in rooms.values() for f, t in group]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences take each; together they hold exactly the counted pieces."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[Filling, int]] = []
    if left[capacity]:
        out.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    if not left.any():
        return out
    ends = []
    bound = -(-int((left * np.arange(capacity + 1)).sum()) // capacity)
    for rule in (*RULES, *COVERING):
        if isinstance(rule, int):
            if min(sum(t for _, t in e) for e in ends) <= bound * (1 + CLOSE) + 1:
                break
            use, least = covered(left, capacity, rule)
            bound = max(bound, math.ceil(least - 1e-6))
        else:
            use = relaxed(left, capacity, *rule)
        rest, rounded = left.copy(), []
        for filling, x in sorted(use.items(), key=lambda f: (-sum(a * k for a, k in f[0]), -f[1], f[0])):
            times = min(int(x + 1e-9), *(int(rest[a]) // k for a, k in filling))
            if times > 0:
                rounded.append((filling, times))
                for a, k in filling:
                    rest[a] -= times * k
        ends += [rounded + _fullest(rest, capacity), rounded + best_fit(rest, capacity)]
    chosen = min(ends, key=lambda e: sum(t for _, t in e))
    log.info("%d sequences, at least %d are needed", sum(t for _, t in out + chosen), bound + sum(t for _, t in out))
    return out + chosen


def _places(fillings: list[tuple[Filling, int]], capacity: int) -> list[np.ndarray]:
    """For each length the rows (first rank, first sequence, pieces per sequence, offset) of its places."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    rank, sequence = [0] * (capacity + 1), 0
    for filling, times in fillings:
        offset = 0
        for x, k in filling:
            rows[x].append((rank[x], sequence, k, offset))
            rank[x] += k * times
            offset += x * k
        sequence += times
    return [np.array(r, np.int64).reshape(-1, 4) for r in rows]


def _placed(places: list[np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1, [len(order)]])
            for a, b in pairwise(edges.tolist()):
                if a == b:
                    continue
                rows = order[a:b]
                table = places[int(length[rows[0]])]
                seg = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - seg[:, 0]
                sequence[rows] = seg[:, 1] + nth // seg[:, 2]
                offset[rows] = seg[:, 3] + nth % seg[:, 2] * length[rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids).

    Null and empty texts are a piece of the end id alone.  Documents that repeat
    are packed as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = _PIECE + (", ids array<int>" if keep_ids else "")
    pieces = scratch.saved(docs.select("doc_id", "text").mapInArrow(_tokenised(path, capacity, end_id, keep_ids), kind), "pieces")
    groups = scratch.saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "groups")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    places = _places(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.saved(groups.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    scratch.release(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_placed(places, names), schema)
