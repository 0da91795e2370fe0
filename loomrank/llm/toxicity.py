"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters; a token's features are its lower-cased word and its
prefixes.  Labelled documents say which documents are toxic, not which words: in
a bounded sample of them, a token of a toxic document is labelled toxic if one of
its features goes with toxic documents far beyond chance (a likelihood-ratio
test), every other token is clean.  The two-state field is fitted on all tokens of
the sampled texts, cut into windows of WINDOW tokens (a text's last one is shorter).

Scoring runs forward and backward over whole texts.  Tokens without a selected
feature all have the same potentials, so a run of n of them is the n-th power of
one 2 x 2 matrix, and the recursion only steps from one token with evidence to the
next.  A document's score calibrates its marginals (the largest one and their sum
over evidence) by a logistic regression on the sampled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm import scratch
from loomrank.llm.bytescan import LETTER, LOWER, SECOND, U64, Rolling, chunks, mix, words

#: Labelled rows that training takes at most, of each label, and the most bytes of each.
SAMPLE, LONGEST, LONG_BYTES = {1: 2500, 0: 5000}, 1 << 16, 1 << 26
PREFIXES = (4, 5, 7)
#: Least likelihood ratio (G squared) and documents of a feature that marks toxic tokens; features kept at most.
EVIDENCE, SUPPORT, FEATURES = 17.0, 4, 5000
WINDOW, ROUNDS, RIDGE = 24, 150, 1e-3
#: Windows that a step of the fit holds at once.
BLOCK = 1 << 13
SCAN = 1 << 18
#: Bytes of toxic texts whose features are counted in one pass.
PASS = 1 << 23
_FILTER = 1 << 20
_state: dict = {}


@dataclass
class Field:
    """Selected features (sorted) with their weights, the toxic state's bias, transition scores, and the calibration."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    calibration: np.ndarray
    prior: float


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, each text's first token, and features (token by kind)."""
    if "hash" not in _state:
        _state["hash"] = Rolling(*SECOND)
    lowered = LOWER[data]
    start, end, first = words(lowered, at, LETTER)
    hashes = _state["hash"]
    prefix = hashes.prefix(lowered)
    size = end - start
    kinds = [mix(hashes.spans(prefix, start, end) + U64(1))]
    for n in PREFIXES:
        kinds.append(np.where(size >= n, mix(hashes.spans(prefix, start, np.minimum(start + n, end)) + U64(2 * n)), U64(0)))
    return start, end, first, np.stack(kinds, axis=1)


def _by_text(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's features, token by kind; computed again each time, as all at once would fill the driver."""
    for r0, r1, data, at in chunks(pa.array(texts, pa.large_string()), SCAN):
        _, _, first, f = tokens(data, at)
        for i in range(r1 - r0):
            yield f[first[i] : first[i + 1]]


def _counted(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of SUPPORT and more toxic texts, sorted, with their numbers of toxic and clean texts.

    Counted a range of features after the other, so that not all of the toxic texts' are held at once.
    """
    bad, good = ([x for x, y in zip(texts, toxic, strict=True) if y == mark] for mark in (1, 0))
    parts = 1 + sum(len(x) for x in bad) // PASS
    edges = [U64(i * (1 << 64) // parts) for i in range(parts)] + [U64((1 << 64) - 1)]
    found = []
    for i in range(parts):
        last = i == parts - 1
        low, high = edges[i], edges[i + 1]
        each = [np.unique(f[(f >= low) & ((f < high) | last)]) for f in _by_text(bad)]
        keys, t = np.unique(np.concatenate(each), return_counts=True)
        found.append((keys[(t >= SUPPORT) & (keys != 0)], t[(t >= SUPPORT) & (keys != 0)]))
        del each
    keys, t = (np.concatenate(x) for x in zip(*found, strict=True))
    c = np.zeros(len(keys))
    for f in _by_text(good) if len(keys) else ():
        f = np.unique(f)
        at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
        c[at[keys[at] == f]] += 1
    return keys, t, c


def _selected(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Features that go with toxic documents far beyond chance, sorted."""
    keys, t, c = _counted(texts, toxic)
    if not len(keys):
        return keys
    nt, nc = max(1.0, toxic.sum()), max(1.0, len(toxic) - toxic.sum())
    share = nt / (nt + nc)
    both = t + c
    g = 2 * (t * np.log(t / (both * share)) + np.where(c > 0, c * np.log(np.maximum(c, 1) / (both * (1 - share))), 0))
    marks = (g >= EVIDENCE) & (t / nt / (t / nt + (c + 0.5) / nc) > 0.9)
    order = np.flatnonzero(marks)
    if len(order) > FEATURES:
        order = np.sort(order[np.argsort(-g[order], kind="stable")[:FEATURES]])
    return keys[order]


def _emissions(feature: np.ndarray, keys: np.ndarray, quick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (token, index of selected feature)."""
    row, kind = np.nonzero(quick[(feature & U64(_FILTER - 1)).astype(np.int64)])
    value = feature[row, kind]
    k = np.minimum(np.searchsorted(keys, value), max(len(keys) - 1, 0))
    hit = keys[k] == value if len(keys) else np.zeros(len(row), bool)
    return row[hit], k[hit]


def _quick(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(_FILTER, bool)
    out[(keys & U64(_FILTER - 1)).astype(np.int64)] = True
    return out


def _forward_backward(score: np.ndarray, moves: np.ndarray, start: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over windows (row by step): log partition, marginals of the toxic state, and expected moves.

    start: the states before the first tokens, clean if not given; weight: how often each window counts.
    """
    n, steps = score.shape
    start = np.zeros(n, np.int64) if start is None else start
    weight = np.ones(n) if weight is None else weight
    t = np.exp(moves)
    emit = np.stack([np.ones_like(score), np.exp(score)], axis=2)
    a, scale = np.zeros((n, steps, 2)), np.zeros((n, steps))
    now = np.eye(2)[start]
    for i in range(steps):
        now = (now @ t) * emit[:, i]
        scale[:, i] = now.sum(1)
        now = now / scale[:, i, None]
        a[:, i] = now
    b = np.ones((n, steps, 2))
    for i in range(steps - 2, -1, -1):
        nxt = (b[:, i + 1] * emit[:, i + 1]) @ t.T
        b[:, i] = nxt / scale[:, i + 1, None]
    marginal = a * b
    marginal /= marginal.sum(2, keepdims=True)
    pair = a[:, :-1, :, None] * t[None, None] * (emit[:, 1:] * b[:, 1:])[:, :, None, :] / scale[:, 1:, None, None]
    expected = np.einsum("n,nsij->ij", weight, pair)
    np.add.at(expected, start, weight[:, None] * marginal[:, 0])
    return (weight * np.log(scale).sum(1)).sum(), marginal[:, :, 1], expected


@dataclass
class Block:
    """Different windows of one length: labels (row by step), states before them, how often each occurs, and its evidence (cell, feature)."""

    labels: np.ndarray
    start: np.ndarray
    weight: np.ndarray
    cell: np.ndarray
    which: np.ndarray


def _blocks(hits: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], toxic: np.ndarray) -> Iterator[Block]:
    """All tokens of all texts as windows, equal ones once with their number; at most BLOCK windows at a time."""
    found: Counter = Counter()
    for (row, k), n, bad in zip(hits, sizes, toxic, strict=True):
        after = row + 1
        own = np.unique(np.concatenate([row, after[after < n]]) // WINDOW)  # the others have no evidence, nor a toxic token before them
        first, last = own * WINDOW, np.minimum((own + 1) * WINDOW, n)
        lows, highs = np.searchsorted(row, first), np.searchsorted(row, last)
        for s, e, a, b in zip(first.tolist(), last.tolist(), lows.tolist(), highs.tolist(), strict=True):
            before = bool(bad) and a > 0 and int(row[a - 1]) == s - 1
            found[e - s, bool(bad) and b > a, before, (row[a:b] - s).astype(np.uint8).tobytes(), k[a:b].astype(np.int32).tobytes()] += 1
        whole, rest = divmod(n, WINDOW)
        found[WINDOW, False, False, b"", b""] += whole - int((own < whole).sum())
        if rest and whole not in own:
            found[rest, False, False, b"", b""] += 1
    of_length: dict[int, list] = {}
    for key, count in found.items():
        if count:
            of_length.setdefault(key[0], []).append((key, count))
    for steps, windows in sorted(of_length.items()):
        for at in range(0, len(windows), BLOCK):
            part = windows[at : at + BLOCK]
            cells = [np.frombuffer(key[3], np.uint8) for key, _ in part]
            cell = np.concatenate(cells).astype(np.int64) + np.repeat(np.arange(len(part)) * steps, [len(c) for c in cells])
            which = np.concatenate([np.frombuffer(key[4], np.int32) for key, _ in part]).astype(np.int64)
            labels = np.zeros(len(part) * steps, np.int64)
            labels[cell] = 1
            labels = labels.reshape(-1, steps) * np.array([key[1] for key, _ in part], np.int64)[:, None]
            yield Block(labels, np.array([key[2] for key, _ in part], np.int64), np.array([count for _, count in part], float), cell, which)


def _fitted(blocks: list[Block], m: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and moves by gradient ascent (Adam) on the windows' log likelihood."""
    theta = np.zeros(m + 5)
    theta[m] = -3.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    seen, n = np.zeros(4), 0.0
    for b in blocks:
        steps = b.labels.shape[1]
        before = np.concatenate([b.start[:, None], b.labels[:, :-1]], axis=1)
        seen += np.bincount((before * 2 + b.labels).reshape(-1), weights=np.repeat(b.weight, steps), minlength=4)
        n += steps * b.weight[np.unique(b.cell // steps)].sum()  # plain text, however long, doesn't strengthen the ridge
    for step in range(1, ROUNDS + 1):
        grad = np.concatenate([np.zeros(m + 1), seen])
        for b in blocks:
            score = np.full(b.labels.size, theta[m])
            np.add.at(score, b.cell, theta[b.which])
            _, marginal, moved = _forward_backward(np.clip(score, -30, 30).reshape(b.labels.shape), theta[m + 1 :].reshape(2, 2), b.start, b.weight)
            gap = ((b.labels - marginal) * b.weight[:, None]).reshape(-1)
            grad[:m] += np.bincount(b.which, weights=gap[b.cell], minlength=m)
            grad[m] += gap.sum()
            grad[m + 1 :] -= moved.reshape(-1)
        grad = grad / n * 1000 - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:m], float(theta[m]), theta[m + 1 :].reshape(2, 2)


def marginals(evidence: np.ndarray, place: np.ndarray, begin: np.ndarray, size: np.ndarray, field: Field) -> np.ndarray:
    """Marginals of tokens with evidence: their scores, places in their texts, each text's slice, and texts' numbers of tokens."""
    t = np.exp(field.moves)
    m = t * np.array([1.0, np.exp(field.bias)])[None, :]
    values, vectors = np.linalg.eig(m)
    top = int(np.argmax(values.real))
    values, vectors = values.real[[top, 1 - top]], vectors.real[:, [top, 1 - top]]
    inverse = np.linalg.inv(vectors)
    big, small = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
    ratio = values[1] / values[0]

    def run(n: np.ndarray) -> np.ndarray:
        """Powers of the default step, scaled."""
        return big[None] + (np.sign(ratio) ** (n % 2) * np.abs(ratio) ** n)[:, None, None] * small[None]

    docs = len(begin) - 1
    many = np.diff(begin)
    gap = np.diff(np.concatenate([[0], place])) - 1
    lead = begin[:-1][many > 0]
    gap[lead] = place[lead]
    emit = np.stack([np.ones(len(evidence)), np.exp(np.clip(evidence + field.bias, -30, 30))], axis=1)
    alpha, beta = np.zeros((len(evidence), 2)), np.zeros((len(evidence), 2))
    order = np.argsort(-many, kind="stable")
    counts = -many[order]
    now = np.tile(np.array([1.0, 0.0]), (docs, 1))
    for i in range(int(many.max(initial=0))):
        n = int(np.searchsorted(counts, -i, "left"))
        at = begin[order[:n]] + i
        x = np.einsum("ni,nij->nj", now[:n], run(gap[at])) @ t
        x = np.maximum(x, 0) * emit[at]
        now = x / x.sum(1, keepdims=True)
        alpha[at] = now
    tail = size - 1 - np.where(many > 0, place[np.maximum(begin[1:] - 1, 0)] if len(place) else 0, 0)
    now = np.ones((docs, 2))
    for i in range(int(many.max(initial=0))):
        n = int(np.searchsorted(counts, -i, "left"))
        at = begin[order[:n] + 1] - 1 - i
        if i == 0:
            now = np.einsum("nij->ni", run(tail[order[:n]]))
        else:
            after = at + 1
            now = np.einsum("nij,nj->ni", run(gap[after]), (now[:n] * emit[after]) @ t.T)
        now = np.maximum(now, 0)
        now = now / now.sum(1, keepdims=True)
        beta[at] = now
    both = alpha * beta
    return both[:, 1] / both.sum(1)


def _summary(p: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per text: log odds of the largest marginal, and the log of the expected number of toxic tokens."""
    many = np.diff(begin)
    padded = np.append(p, 0.0)
    top = np.where(many > 0, np.maximum.reduceat(padded, begin[:-1]), 0.0)
    total = np.where(many > 0, np.add.reduceat(padded, begin[:-1]), 0.0)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(many)), np.log(top / (1 - top)), np.log1p(total)], axis=1)


def _calibrated(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.5, 0.5])
        step = np.linalg.solve(h, x.T @ (weight * (toxic - p)) - np.array([1e-6, 0.5, 0.5]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int], rates: tuple[float, float] = (1.0, 1.0)) -> Field:
    """A field from labelled texts; rates: by how much each label (clean, toxic) was thinned out."""
    y = np.array(toxic, np.int64)
    prior = float((y * rates[1]).sum() / max(1e-9, (y * rates[1] + (1 - y) * rates[0]).sum())) if len(y) else 0.0
    none = Field(np.zeros(0, U64), np.zeros(0), -30.0, np.zeros((2, 2)), np.array([np.log(max(prior, 1e-4) / (1 - min(prior, 1 - 1e-4))), 0, 0]), prior)
    if not len(y) or y.min() == y.max():
        return none
    with np.errstate(over="ignore"):
        keys = _selected(texts, y)
        if not len(keys):
            return none
        quick = _quick(keys)
        hits, sizes = [], []
        for f in _by_text(texts):
            hits.append(_emissions(f, keys, quick))
            sizes.append(len(f))
    weights, bias, moves = _fitted(list(_blocks(hits, sizes, y)), len(keys))
    field = Field(keys, weights, bias, moves, none.calibration, prior)
    x = np.concatenate([_summary(*_scored(*h, n, field)) for h, n in zip(hits, sizes, strict=True)])
    field.calibration = _calibrated(x, y.astype(float), np.where(y == 1, rates[1], rates[0]) / max(rates))
    return field


def _scored(row: np.ndarray, k: np.ndarray, n: int, field: Field) -> tuple[np.ndarray, np.ndarray]:
    place, back = np.unique(row, return_inverse=True)
    evidence = np.bincount(back, weights=field.weights[k], minlength=len(place))
    begin = np.array([0, len(place)])
    return marginals(evidence, place, begin, np.array([n]), field), begin


def _score(field: Field, below: float | None = None):
    """Scores and spans of (doc_id, text); with `below` the batches' rows, all columns, that score less."""
    quick = _quick(field.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for r0, r1, data, at in chunks(batch.column(batch.schema.get_field_index("text")), SCAN):
                    start, end, first, feature = tokens(data, at)
                    row, k = _emissions(feature, field.keys, quick)
                    token, back = np.unique(row, return_inverse=True)
                    evidence = np.bincount(back, weights=field.weights[k], minlength=len(token))
                    begin = np.searchsorted(token, first)
                    doc = np.repeat(np.arange(r1 - r0), np.diff(begin))
                    p = marginals(evidence, token - first[doc], begin, np.diff(first), field)
                    score = 1 / (1 + np.exp(-np.clip(_summary(p, begin) @ field.calibration, -30, 30)))
                    if below is not None:
                        yield batch.slice(r0, r1 - r0).filter(pa.array(score < below))
                        continue
                    hot = p >= 0.5
                    edges = np.concatenate([[0], np.cumsum(hot)])[begin].astype(np.int32)
                    span = pa.StructArray.from_arrays([pa.array(start[token[hot]] - at[doc[hot]]), pa.array(end[token[hot]] - at[doc[hot]])], ["start", "end"])
                    yield pa.RecordBatch.from_arrays([batch.column(0)[r0:r1], pa.array(score), pa.ListArray.from_arrays(pa.array(edges), span)], ["doc_id", "score", "spans"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits on at most SAMPLE rows of each label, in the order of a hash of their ids.

    Texts of at most LONGEST bytes come first; where they are too few, longer ones
    follow in the same order, whole, up to LONG_BYTES of each label altogether.
    """
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = {int(r["toxic"] > 0): r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    # what can't be used goes before rows are drawn, so it takes no one's place
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).where("size > 0").join(rows, "doc_id")
    usable = scratch.saved(sizes.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size")), "usable")
    texts: list[str] = []
    marks: list[int] = []
    taken = {0: 0, 1: 0}
    for mark, most in SAMPLE.items():
        if not known.get(mark):
            continue
        own = usable.where((F.col("toxic") > 0).cast("int") == mark)
        long = (F.col("size") > LONGEST).alias("long")
        drawn = own.select("doc_id", "size", long).orderBy("long", F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        ids, left = [], LONG_BYTES
        for r in drawn:
            if r["long"]:
                left -= r["size"]
            if left >= 0:
                ids.append(r["doc_id"])
        wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")  # at most SAMPLE rows
        found = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(wanted), "doc_id").collect()
        found.sort(key=lambda r: (r[0], r[1]))
        texts += [r[1] for r in found]
        marks += [mark] * len(found)
        taken[mark] = max(1, len(found))
    return fit(texts, marks, tuple(known.get(m, 0) / max(1, taken[m]) for m in (0, 1)))


def in_training(column: str = "doc_id"):
    """Rows whose labels may be learnt from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 != 2


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: held_out, score, predicted, and the byte spans of its toxic tokens.

    Null and empty texts are scored as texts without evidence; rows without an id
    are scored too and aren't held out.  Without labelled
    rows of both kinds every document has the known share of toxic ones as score.
    """
    field = train(docs, labels.where(in_training()))
    out = docs.select("doc_id", "text").mapInArrow(_score(field), "doc_id long, score double, spans array<struct<start:long,end:long>>")
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that aren't predicted toxic, all columns; no row moves to another task.

    Null and empty texts have no evidence and stay where plain ones do; rows that repeat stay or go together.
    """
    return docs.mapInArrow(_score(train(docs, labels.where(in_training())), threshold), docs.schema)
