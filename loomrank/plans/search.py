"""Ranked search of a batch of queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank import storage
from loomrank.operators import planning, ranking
from loomrank.operators.planning import EXHAUSTIVE, Mode
from loomrank.operators.segments import exploded
from loomrank.plans.index import Index, dealt
from loomrank.schema import BLOCK_BITS

#: Terms of a batch that are looked up by a filter which reaches the Parquet scan; beyond, the join alone finds them.
PUSHED_TERMS = 10_000
#: Sums of a task at most, about: queries times documents.
SUMS = 1 << 19
#: Bits of blocks in a zone: a long has a bit for each of them.
ZONE_BITS = 6


def narrowed(index: Index, query_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """directory and blocks of the batch's terms, if those are few."""
    terms = [r[0] for r in query_terms.select("token").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(terms) > PUSHED_TERMS:
        return index.directory, index.blocks
    quoted = ("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)
    wanted = F.expr(f"term IN ({', '.join(quoted)})") if terms else F.lit(False)  # one expression: a call per term would take longer than the search
    return index.directory.where(wanted), index.blocks.where(wanted)


def cuts(index: Index, query_terms: DataFrame, mode: Mode = EXHAUSTIVE, directory: DataFrame | None = None) -> DataFrame:
    """How far down each token's segments are processed; an exhaustive search reads no directory for it."""
    if mode.exhaustive:
        return planning.uncut(query_terms)
    return planning.cuts(planning.selected(planning.planned(index.directory if directory is None else directory, query_terms), mode))


@dataclass
class Warm:
    """What a batch's tokens have in an index, held: their directory and tops, and of their highest segments the blocks and documents."""

    tokens: DataFrame
    directory: DataFrame
    tops: DataFrame
    blocks: DataFrame
    docs: DataFrame

    def unpersist(self) -> None:
        for x in (self.tokens, self.directory, self.tops, self.blocks, self.docs):
            x.unpersist()


def warmed(index: Index, query_terms: DataFrame) -> Warm:
    """Reads a batch's tokens and their highest segments once and holds them, on disk where memory ends."""
    index = index.of(query_terms)
    tokens = query_terms.select(F.col("token").alias("term")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    directory, tops = (x.join(tokens, "term", "left_semi").persist(StorageLevel.MEMORY_AND_DISK) for x in (index.directory, index.tops))
    high = planning.warmup(directory, query_terms.select("token")).select("term", "impact")
    blocks = index.blocks.join(high, ["term", "impact"], "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    docs = index.docs.join(exploded(blocks).distinct(), "doc_id", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    for x in (directory, tops, blocks, docs):
        x.count()
    return Warm(tokens, directory, tops, blocks, docs)


def _from_warm(index: Index, warm: Warm, query_terms: DataFrame, mode: Mode, wrap: bool) -> tuple[DataFrame, bool] | None:
    """Scores, and whether all of them come from what is held; None where the batch has tokens that weren't warmed."""
    if not query_terms.join(warm.tokens, F.col("token") == F.col("term"), "left_anti").isEmpty():
        return None
    highest = warm.directory.groupBy(F.col("term").alias("token")).agg(F.max("impact").alias("highest"))
    down = cuts(index, query_terms, mode, warm.directory).join(highest, "token")
    high = down.where("cut <= highest").withColumn("cut", F.col("highest"))
    hits = ranking.hits(planning.cells(high, warm.tops), warm.blocks)
    below = down.where("cut < highest")
    whole = below.isEmpty()
    if not whole:
        cells = planning.cells(below, warm.tops).join(highest.select(F.col("token").alias("term"), F.col("highest").alias("upper")), "term")
        hits = hits.unionByName(ranking.hits(cells, index.blocks))
    return ranking.summed(hits, wrap), whole


def shared_among(index: Index, query_terms: DataFrame) -> int:
    """Tasks that share the sums of a batch: each has about SUMS of the documents of all queries."""
    queries = query_terms.select("qid").distinct().count()
    return max(query_terms.sparkSession.sparkContext.defaultParallelism, -(-queries * index.num_docs // SUMS))


def scores(index: Index, query_terms: DataFrame, mode: Mode = EXHAUSTIVE, wrap: bool = False, push: bool = False) -> DataFrame:
    index = index.of(query_terms)
    directory, blocks = narrowed(index, query_terms) if push and index.stored else (index.directory, index.blocks)
    if not index.stored:  # tables that are held have no buckets, and segments meet them with one step less
        return ranking.accumulated(planning.selected(planning.planned(directory, query_terms), mode), blocks, wrap, shared_among(index, query_terms))
    return by_cells(index, query_terms, mode, wrap, directory, blocks)


def by_cells(index: Index, query_terms: DataFrame, mode: Mode = EXHAUSTIVE, wrap: bool = False, directory: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """The same scores from cells (query, token, block), which meet stored blocks by their buckets."""
    index = index.of(query_terms)
    cells = planning.cells(cuts(index, query_terms, mode, directory), index.tops)
    return ranking.summed(ranking.hits(cells, index.blocks if blocks is None else blocks), wrap)


def search(
    index: Index, query_terms: DataFrame, k: int = 10, mode: Mode = EXHAUSTIVE, pad: bool = False, wrap: bool = False, push: bool = False, warm: Warm | None = None,
) -> DataFrame:
    """results: qid, rank, doc_id, ext_id, score of the k best documents of every query.

    On a stored index the batch's tokens become cells (query, token, block) that
    meet the blocks; on one that is held its segments do.
    pad: queries with fewer than k matching documents get zero scores of the
    lowest ids.  wrap: 16-bit levels and sums.  push: a batch of few terms also
    filters the scan by them, so that row groups of a stored index are skipped.
    warm: what warmed() holds is read from there; a batch that needs no more, as
    one with a budget of zero, reads no storage.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    held = _from_warm(index, warm, query_terms, mode, wrap) if warm else None
    found = held[0] if held else scores(index, query_terms, mode, wrap, push)
    if pad:
        found = ranking.padded(found, query_terms.select("qid").distinct(), k, index.num_docs)
    return ranking.named(ranking.top_k(found, k), warm.docs if held and held[1] and not pad else index.docs)


@dataclass
class Skipping:
    """scores of all documents that can be among the k best; cells: how many a full search would read; read: how many this one reads."""

    scores: DataFrame
    cells: DataFrame
    read: DataFrame


def skipping(index: Index, query_terms: DataFrame, k: int = 10, mode: Mode = EXHAUSTIVE, seeds: int = 1, share: float = 1 / 8) -> Skipping:
    """Scores by blocks, without those blocks that can't reach the k best.

    A block's bound is the sum of its tokens' largest levels.  The first round gives
    a threshold that the k-th best score can't be below: the k-th best of the partial
    scores from the highest segments (a `share` of the query's postings), or of the
    whole scores in the query's `seeds` blocks of the highest bound, whichever is
    more.  The second round reads only blocks whose bound reaches it; one that equals
    it may hold a document with a smaller id.  Queries with fewer than k documents in
    the first round read all blocks.

    What the batch's tokens have is dealt out once, by query and zone (a run of blocks),
    and written; bounds, thresholds and sums are all made within these buckets.
    """
    inner = min(ZONE_BITS, BLOCK_BITS - index.block_bits)
    own = index.of(query_terms)
    down = cuts(own, query_terms, mode)
    high = planning.bands(planning.with_prior(planning.planned(own.directory, query_terms)), (share,)).select("qid", "pos", "cut_0")
    batch = down.join(high, ["qid", "pos"]).select("qid", F.col("token").alias("term"), "weight", "cut", F.greatest("cut", "cut_0").alias("high"))
    tasks = shared_among(index, query_terms)
    met = index.zones(query_terms, inner).join(storage.saved(batch, "batch"), "term").where("most >= cut")
    zones = dealt(met.select("qid", "zone", "weight", "cut", "high", "most", "tops", "codes"), "zones", tasks)
    tops = zones.select("qid", "zone", "weight", "cut", F.explode("tops").alias("t")).select("qid", "zone", "weight", "cut", F.expr("shiftright(t, 16)").alias("nth"), F.expr("t & 65535").alias("top"))
    bounds = dealt(tops.where("top >= cut").groupBy("qid", "zone", "nth").agg(F.sum(F.col("top").cast("long") * F.col("weight")).alias("bound")), "bounds", tasks)
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "zone", "nth")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= seeds)

    def scores(rows: DataFrame, cut: str, mask: str | None = None) -> DataFrame:
        return ranking.zone_scores(rows, index.block_bits, inner, index.docs.schema["doc_id"].dataType, cut, mask)

    seeded = ranking.thresholds(scores(zones.join(ranking.masks(first), ["qid", "zone"]), "cut", "mask"), k)
    partial = ranking.thresholds(scores(zones.where("most >= high"), "high"), k)
    theta = storage.saved(seeded.unionByName(partial).groupBy("qid").agg(F.max("theta").alias("theta")), "thresholds")
    alive = bounds.join(theta, "qid", "left").where("theta IS NULL OR bound >= theta")
    found = scores(zones.join(ranking.masks(alive).hint("shuffle_hash"), ["qid", "zone"]), "cut", "mask")
    cells = planning.cells(down, own.tops)
    block = (F.shiftleft("zone", inner) + F.col("nth")).alias("block")
    return Skipping(found, cells, cells.join(alive.select("qid", block), ["qid", "block"], "left_semi"))


def search_skipping(index: Index, query_terms: DataFrame, k: int = 10, mode: Mode = EXHAUSTIVE, seeds: int = 1, share: float = 1 / 8) -> DataFrame:
    """The results of search(), by skipping()."""
    if k < 1 or seeds < 1:
        raise ValueError("k and seeds must be at least 1")
    return ranking.named(ranking.top_k(skipping(index, query_terms, k, mode, seeds, share).scores, k), index.docs)


def fraction(index: Index, query_terms: DataFrame, rho: float, k: int = 10, **options) -> DataFrame:
    return search(index, query_terms, k, Mode(fraction=rho), **options)


def fixed(index: Index, query_terms: DataFrame, budget: int, k: int = 10, **options) -> DataFrame:
    return search(index, query_terms, k, Mode(fixed=budget), **options)


def warmup(index: Index, query_terms: DataFrame) -> int:
    """Reads the highest segment of every token once and returns how many there are."""
    index = index.of(query_terms)
    return planning.warmup(index.directory, query_terms.select("token")).join(index.blocks, ["term", "impact"]).count()
