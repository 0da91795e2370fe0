"""Near-duplicate documents: MinHash candidates, exact confirmation, connected components.

Each document's distinct 5-word shingles are one-permutation hashed into
BANDS * ROWS bins; empty bins take the value of another bin, found by their own
fixed probing order over bins (optimal densification).  Bands of ROWS bins are
bucket keys.  With 48 bands of 5 a pair at similarity 0.75 stays without a common
bucket with probability (1 - 0.75**5)**48, about 2e-6.

Documents with the same shingle set (128 bits of a hash of all its words) become one
class before bucketing.  Within a bucket the smallest member is a star's centre and
is paired with the others, so a bucket of m members gives m - 1 pairs.  Pairs are
confirmed on the full sets of shingles, word by word.  Buckets whose members then still belong to different components get the
next centre.  After STARS such rounds an exact prefix filter takes the documents
of the buckets that are still mixed: with shingles in order of their frequency,
two similar sets share one of the first n - ceil(0.75 n) + 1 of each.  Passages
that many documents share come last in that order and make no pairs, and no link
that matters for a component is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm import scratch
from loomrank.llm.bytescan import LOWER, U64, chunks, digests, lanes, mix, strings, words

SHINGLE = 5
BANDS, ROWS = 48, 5
STARS = 2
SCAN = 1 << 18
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_state: dict = {}


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE, wide: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of every text's shingles with repeats (two of each if wide), and where each text's begin (one more at the end).

    A text with fewer words has its whole sequence as its one shingle.
    """
    lowered = LOWER[data]
    start, end, first = words(lowered, at)
    hashed = digests(lanes(lowered), lowered, start, end, (0x13198A2E, 0x03707344)[: 1 + wide])
    n = np.diff(first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    total = int(begin[-1])
    if not total:
        return [np.zeros(0, U64)] * (1 + wide), begin
    place = np.arange(total) + np.repeat(first[:-1] - begin[:-1], many)
    left = np.repeat(np.minimum(n, size), many)  # words in the shingle
    some = int(n[n > 0].min()) < size
    out = []
    for word in hashed:
        padded = np.append(word, np.zeros(size, U64))
        x = np.zeros(total, U64)
        for i in range(size):
            part = padded[place + i]
            if i and some:
                part = np.where(left > i, part, U64(0))
            x = mix(x * U64(0x9E3779B97F4A7C15) + part + U64(i))
        out.append(x)
    return out, begin


def distinct(values: list[np.ndarray], begin: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct values of each slice (with what stands beside them in the other arrays), and where each slice then begins."""
    one = values[0]
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((one, row)) if len(values) > 1 else None
    if order is None:
        ranked = np.concatenate([np.sort(one[b:e]) for b, e in zip(begin[:-1], begin[1:], strict=True)]) if len(begin) > 1 else one
    else:
        ranked = one[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (row[1:] != row[:-1])
    sizes = np.bincount(row[new], minlength=len(begin) - 1)
    return [ranked[new], *(x[order[new]] for x in values[1:])], np.concatenate([[0], np.cumsum(sizes)])


def _probes(bins: int) -> np.ndarray:
    """For each bin its own order of all bins."""
    if ("probes", bins) not in _state:
        rng = np.random.Generator(np.random.PCG64(20240229))
        _state["probes", bins] = np.argsort(rng.random((bins, bins)), axis=1)
    return _state["probes", bins]


def signature(sets: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of every set, densified; rows of empty sets hold no information."""
    n = len(begin) - 1
    sig = np.full(n * bins, _EMPTY, U64)
    h = mix(sets ^ U64(0x243F6A8885A308D3))
    row = np.repeat(np.arange(n), np.diff(begin))
    bin_ = ((h >> U64(32)) * U64(bins)) >> U64(32)
    np.minimum.at(sig, row * bins + bin_.astype(np.int64), (mix(h) & U64(0x7FFFFFFFFFFFFFFF)))
    sig = sig.reshape(n, bins)
    full = sig != _EMPTY
    r, b = np.nonzero(~full & (np.diff(begin) > 0)[:, None])
    probes = _probes(bins)
    for step in range(bins):
        if not len(r):
            break
        source = probes[b, step]
        hit = full[r, source]
        sig[r[hit], b[hit]] = sig[r[hit], source[hit]]
        r, b = r[~hit], b[~hit]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), U64)
    parts = sig.reshape(len(sig), bands, rows)
    for i in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return mix(out + np.arange(bands, dtype=U64)[None, :])


def _signed(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for r0, r1, data, at in chunks(batch.column(1), SCAN):
                    (sets, others), begin = distinct(*shingles(data, at, size, wide=True))
                    many = np.diff(begin)
                    total = lambda x: np.add.reduceat(np.append(x, U64(0)), begin[:-1]) * (many > 0).astype(U64)
                    one, two = total(mix(sets)), total(mix(others))
                    keys = band_keys(signature(sets, begin, bands * rows), bands, rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[r0:r1], pa.array(many), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "n_shingles", "set1", "set2", "bands"]
                    )

    return run


def exact_shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Every text's sorted distinct shingles as numbers; over these texts, equal numbers are equal words in equal order.

    Words are numbered, then runs of words by pairs of shorter runs' numbers.
    """
    number: dict[bytes, int] = {}
    own = [[number.setdefault(w, len(number) + 1) for w in t.lower().split()] for t in texts]  # bytes: lowers A-Z, splits at ASCII white space
    many = np.array([max(len(w) - size + 1, min(len(w), 1)) for w in own], np.int64)
    flat = np.fromiter((i for w in own for i in (*w, *[0] * size)), np.int64)  # zeros: no word
    first = np.cumsum([0, *(len(w) + size for w in own)])[:-1]
    begin = np.concatenate([[0], np.cumsum(many)])
    place = np.arange(int(begin[-1])) + np.repeat(first - begin[:-1], many)
    runs, length = flat, 1
    while length < size:  # the run from each word on, longer by as much as fits
        step = min(length, size - length)
        _, named = np.unique(runs, return_inverse=True)
        runs = named * np.int64(named.max(initial=0) + 1) + np.append(named[step:], np.zeros(step, np.int64))
        length += step
    got = runs[place]
    return [np.unique(got[b:e]) for b, e in zip(begin[:-1], begin[1:], strict=True)]


def _confirmed(percent: int, size: int):
    """Pairs (a, b, text_a, text_b) whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("text_a"), batch.column("text_b")
            ends = (strings(left)[1] + strings(right)[1])[1:]
            rows = 0
            while rows < len(left):  # runs of pairs of bounded size; one pair at least
                upto = max(rows + 1, int(np.searchsorted(ends, (ends[rows - 1] if rows else 0) + 2 * SCAN, "right")))
                sets = exact_shingles([t.as_buffer().to_pybytes() for part in (left, right) for t in part[rows:upto]], size)
                for a, b in zip(sets[: upto - rows], sets[upto - rows :], strict=True):
                    both = np.concatenate([a, b])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared))
                rows = upto
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return got.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(percent, size), "a long, b long")


def components(links: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    Alternates each id's step to its neighbourhood's smallest label with jumps to
    that label's own label, so that chains shorten by half in each round.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    both = scratch.saved(both, "links")
    labels = scratch.saved(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")) if seen is None else seen, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        step = scratch.saved(step, "step")
        roots = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = scratch.saved(step.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"), F.col("was")), "labels")
        done = after.where("component <> was").limit(1).count() == 0
        scratch.drop(step)
        scratch.drop(labels)
        labels = after
        if done:
            scratch.drop(both)
            return labels.select("id", "component")


def _star(rows: DataFrame, *more: str) -> DataFrame:
    """The smallest member of every bucket (key, id, n) of two and more, with each member: a, b, na, nb (and ca, cb)."""
    columns = {"id": "", "n": "n"} | {c: "c" for c in more}
    centres = scratch.saved(rows.groupBy("key").agg(F.min(F.struct(*columns)).alias("centre"), F.count("*").alias("m")).where("m > 1").drop("m"), "centres")
    return rows.join(centres, "key").select("key", *(F.col(f"centre.{c}").alias(f"{k}a") for c, k in columns.items()), *(F.col(c).alias(f"{k}b") for c, k in columns.items()))


def _fits(percent: int, x: str = "na", y: str = "nb"):
    """Sets of such sizes can be similar enough."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _exploded(size: int):
    """(id, component, n, shingle) for every distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for r0, r1, data, at in chunks(batch.column("text"), SCAN):
                    (sets,), begin = distinct(*shingles(data, at, size))
                    row = pa.array(r0 + np.repeat(np.arange(r1 - r0), np.diff(begin)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("id", "component", "n")), pa.array(sets.view(np.int64))], ["id", "component", "n", "shingle"])

    return run


def _prefix_pairs(some: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """All pairs (a, b) of different components in (id, component, n) that can be similar enough, by their rarest shingles."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = scratch.saved(some.join(texts, "id").select("id", "component", "n", "text").mapInArrow(_exploded(size), "id long, component long, n long, shingle long"), "shingles")
    common = scratch.saved(rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("often > 1"), "common")
    own = Window.partitionBy("id")
    shared = rows.join(common, "shingle").withColumn("nth", F.row_number().over(own.orderBy("often", "shingle"))).withColumn("m", F.count("*").over(own))
    alone = F.col("n") - F.col("m")  # shingles of no other document come first
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = scratch.saved(shared.where((F.col("nth") <= first - alone) & (F.col("c0") < F.col("c1"))).select("id", "component", "n", "shingle", (F.col("m") - F.col("nth") + 1).alias("rest")), "prefixes")
    one, two = (kept.select("shingle", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("rest").alias(f"rest{x}")) for x in "ab")
    # from the first shingle that two similar sets share, both have enough shared ones left
    enough = F.least("resta", "restb") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    return one.join(two, "shingle").where("a < b and ca <> cb").where(_fits(percent) & enough).select("a", "b").distinct()


def classes(docs: DataFrame, percent: int = 75, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Null, empty and blank texts have no shingles and are linked with nothing, not
    even with each other.  Equal sets are linked (similarity 1).  Rows that repeat
    an id are reported as often.  Rows without an id link nothing, have the component
    of equal rows with an id, if any, and aren't kept.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    signed = scratch.saved(texts.mapInArrow(_signed(bands, rows, size), "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"), "signed")
    sets = scratch.saved(signed.where("n_shingles > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("id")), "sets")
    buckets = signed.join(sets.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    star = scratch.saved(_star(buckets), "buckets")  # only buckets of two and more
    scratch.release(spark)
    members = star.select("key", F.col("b").alias("id"), F.col("nb").alias("n"))
    pairs = star.where("a < b").where(_fits(percent)).select("a", "b").distinct()
    links = labels = None
    for turn in range(STARS + 1):
        new = scratch.saved(confirmed(scratch.saved(pairs, "pairs"), docs, percent, size), "links")
        scratch.release(spark)
        links = new if links is None else scratch.saved(links.unionByName(new), "links")
        labels = components(links)
        if turn == STARS:
            break
        # a centre has met all members of its bucket and leaves; buckets of one component are settled
        named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        lead = named.groupBy("key").agg(F.min("id").alias("lead"))
        named = scratch.saved(named.join(lead, "key").where("id <> lead").drop("lead"), "named")
        mixed = scratch.saved(named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key"), "mixed")
        left = scratch.saved(named.join(mixed, "key"), "left")
        scratch.release(spark)
        if not left.limit(1).count():
            break
        members = left.select("key", "id", "n")
        if turn < STARS - 1:
            star = _star(left, "component")
            pairs = star.where("a < b and ca <> cb").where(_fits(percent)).select("a", "b").distinct()
        else:
            pairs = _prefix_pairs(left.select("id", "component", "n").distinct(), docs, percent, size)
    known = sets.join(labels, "id", "left").select("set1", "set2", F.coalesce("component", "id").alias("component"))
    known = scratch.saved(known, "known")
    out = signed.select("doc_id", "n_shingles", "set1", "set2").join(known, ["set1", "set2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def kept(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that are the smallest of their component, all columns; rows without an id stay, of rows with equal id and text one stays."""
    gone = classes(docs, percent).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    twice = scratch.saved(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.limit(1).count():
        once = docs.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
        docs = docs.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
