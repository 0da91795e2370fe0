"""Exact search from the highest levels downwards, in rounds, until a query's best documents are settled.

Each round processes the next band of a query's segments, whole ones only, and adds to accumulators
that lie in files.  What a batch has is dealt out once, by query and zone (a run of blocks), with a column
for each round's postings; accumulators lie in the same buckets, so a round reads its own column and
shuffles no posting and no score but the k best of each task.  What is left of a query has an upper bound: the sum over its
tokens of the highest level that hasn't been processed.  Where the k-th best partial
score is beyond that bound, no document that hasn't been met can be among the k
best, and of those met only the ones that the bound still lifts to the k-th best can.
Such a query leaves: its few candidates get the rest of their scores at the end, with
those of all that left, from the blocks that they lie in, and all other postings stay out of the sums.  Frequent tokens have low
impacts and long lists, so what stays unread is most of the index's postings.

A round starts from files alone: a lost executor costs the round it was lost in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.operators import planning, ranking, segments
from loomrank.plans.index import Index, dealt
from loomrank.plans.search import ZONE_BITS, shared_among
from loomrank.schema import BLOCK_BITS
from loomrank.storage import saved

#: Of a query's postings what each round goes up to; the last round takes all.
SHARES = (1 / 16, 1 / 8, 1 / 4, 1 / 2)
#: A query leaves if its candidates' blocks hold at most this share of the postings that it hasn't read, taking a zone's as spread evenly over its blocks.
WORTH = 0.5


@dataclass
class Round:
    """What a round did: the share of postings it went up to, queries that took part and that left, and the postings read."""

    share: float
    queries: int
    left: int
    postings: int


@dataclass
class Rounds:
    results: DataFrame
    log: list[Round]

    @property
    def postings(self) -> int:
        return sum(r.postings for r in self.log)


def search_rounds(index: Index, query_terms: DataFrame, k: int = 10, shares: tuple[float, ...] = SHARES, worth: float = WORTH, measured: bool = False) -> Rounds:
    """The results of an exhaustive search; measured: the log counts the postings that were read, which takes a scan of its own.

    Queries without known tokens give no results, as in search().  Small blocks
    (see block_bits) make leaving cheap.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    inner = min(ZONE_BITS, BLOCK_BITS - index.block_bits)
    bits, kind = index.block_bits + inner, index.docs.schema["doc_id"].dataType
    tasks, rounds = shared_among(index, query_terms), len(shares) + 1
    lists = saved(index.leveled(query_terms, inner), "lists")
    directory = index.directory if index.lists is None else segments.leveled_directory(lists)
    plan = saved(planning.with_prior(planning.planned(directory, query_terms)), "plan")
    bands = saved(planning.bands(plan, shares), "bands")
    zones = dealt(split(lists, bands, len(shares)), "zones", tasks)
    active, done, gone, log = saved(_facts(plan, bands, shares), "active"), [], [], []
    every = queries = active.count()
    scores: DataFrame | None = None

    def best(sums: DataFrame) -> DataFrame:
        # sums only grow, so what is below the k-th best of the round before stays below it
        high = sums.join(active.select("qid", "theta"), "qid").where("theta IS NULL OR score >= theta")
        return ranking.zone_docs(high, bits, kind)

    for i, share in enumerate((*shares, 1.0)):
        last = i == rounds - 1
        own = (lambda rows: rows) if queries == every else (lambda rows: rows.join(active.select("qid"), "qid", "left_semi"))
        found = _summed(_levels(own(zones), f"codes_{i}", index.block_bits), None if scores is None else own(scores))
        postings = (own(zones).agg(F.sum(F.col(f"left_{i}") - F.col(f"left_{i + 1}"))).first()[0] or 0) if measured else 0
        if last or not queries:
            done.append(saved(ranking.top_k(best(found), k), "results"))
            log.append(Round(share, queries, queries, postings))
            break
        scores = dealt(found, "scores", tasks, lying=True)
        active = saved(active.drop("theta").join(ranking.thresholds(best(scores), k), "qid", "left"), "active")
        settled = active.where(f"theta > rest_{i}").select("qid", "theta", F.col(f"rest_{i}").alias("rest"), F.col(f"unread_{i}").alias("unread"))
        left = 0
        if not settled.isEmpty():
            share_of_blocks = F.expr(f"bit_count(mask) / {1 << inner}")
            cost = zones.join(_masks(_met(scores, settled), index.block_bits), ["qid", "zone"]).groupBy("qid").agg(F.sum(F.col(f"left_{i + 1}") * share_of_blocks).alias("cost"))
            leaving = settled.join(cost, "qid", "left").where(F.coalesce("cost", F.lit(0)) <= worth * F.col("unread"))
            leaving = saved(leaving.select("qid", "theta", "rest"), "leaving")
            left = leaving.count()
        if left:
            gone.append(dealt(_met(scores, leaving).withColumn("round", F.lit(i)), "scores", tasks, lying=True))
            active = saved(active.join(leaving, "qid", "left_anti"), "active")
        log.append(Round(share, queries, left, postings))
        if left == queries:
            break
        queries -= left
    if gone:
        known = reduce(DataFrame.unionByName, gone)
        codes = "CASE round " + " ".join(f"WHEN {i} THEN concat({', '.join(f'codes_{j}' for j in range(i + 1, rounds))})" for i in range(rounds - 1)) + " END"
        rest = _levels(zones.join(_masks(known, index.block_bits, "round"), ["qid", "zone"]), codes, index.block_bits, "mask", F.col("round"))
        done.append(saved(ranking.top_k(ranking.zone_docs(_summed(rest, known, inside=True), bits, kind), k), "results"))
        for r in rest.groupBy("round").count().collect() if measured else ():  # a row a round
            log[r["round"]].postings += r["count"]
    results = reduce(DataFrame.unionByName, done)
    return Rounds(ranking.named(results, index.docs), log)


def split(lists: DataFrame, bands: DataFrame, n: int) -> DataFrame:
    """qid, zone and weight of lists with levels that meet a batch of n shares: codes_i has the postings of round i, left_i counts those of it and later ones."""
    met = lists.join(bands.select("qid", F.col("token").alias("term"), "weight", *(f"cut_{i}" for i in range(n))), "term")
    left = ["count", *(segments.below(f"cut_{i}") for i in range(n)), "0"]
    met = met.select("qid", "zone", "weight", "codes", *(F.expr(x).alias(f"left_{i}") for i, x in enumerate(left)))
    codes = (F.expr(f"slice(codes, left_{i + 1} + 1, left_{i} - left_{i + 1})").alias(f"codes_{i}") for i in range(n + 1))
    return met.select("qid", "zone", "weight", *(f"left_{i}" for i in range(n + 2)), *codes)


def _facts(plan: DataFrame, bands: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Of every query, and for each share: rest_i, the bound of what is beyond it, and unread_i, the postings there; theta, none yet."""
    rest = bands.groupBy("qid").agg(F.count("*").alias("tokens"), *(F.sum(F.col(f"next_{i}").cast("long") * F.col("weight")).alias(f"rest_{i}") for i in range(len(shares))))
    beyond = (F.when(F.col("prior") + F.col("count") > share * F.col("total"), F.col("count")).otherwise(0) for share in shares)
    unread = plan.groupBy("qid").agg(F.sum("count").alias("postings"), *(F.sum(x).alias(f"unread_{i}") for i, x in enumerate(beyond)))
    return rest.join(unread, "qid").withColumn("theta", F.lit(None).cast("long"))


def _levels(zones: DataFrame, codes: str, bits: int, mask: str | None = None, *columns: Column) -> DataFrame:
    """qid, zone, place, score and the given columns of every posting of codes, an array as SQL."""
    hits = ranking.zone_hits(zones, F.expr(codes), bits, mask, *columns)
    return hits.withColumn("score", F.col("impact") * F.col("weight")).drop("impact", "weight", "mask")


def _summed(hits: DataFrame, scores: DataFrame | None, inside: bool = False) -> DataFrame:
    """The sums by qid, zone and place of hits and of scores so far; inside: only of documents that have such scores."""
    rows = hits.withColumn("known", F.lit(0))
    if scores is not None:
        # both sides' buckets are seen through the union as long as its columns are named anew
        rows = _anew(scores.withColumn("known", F.lit(1))).unionByName(_anew(rows))
    sums = rows.groupBy("qid", "zone", "place").agg(F.sum("score").alias("score"), *([F.max("known").alias("known")] if inside else [])).where("score > 0")
    return sums.where("known = 1").drop("known") if inside else sums


def _anew(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(c) for c in ("qid", "zone", "place", "score", "known")))


def _met(scores: DataFrame, settled: DataFrame) -> DataFrame:
    """The scores of settled queries' candidates: those that what is left still lifts to the k-th best."""
    return scores.join(settled.select("qid", "theta", "rest"), "qid").where("score + rest >= theta").select("qid", "zone", "place", "score")


def _masks(met: DataFrame, bits: int, *columns: str) -> DataFrame:
    blocks = met.select(*(F.col(c).alias(c) for c in ("qid", "zone", *columns)), F.shiftright("place", bits).alias("nth"))  # anew, as in _anew()
    return ranking.masks(blocks, *columns).hint("shuffle_hash")
