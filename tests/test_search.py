import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomrank.functions.scoring import BM25, Identity, LinearQuantizer
from loomrank.operators import planning, ranking, segments
from loomrank.operators.planning import Mode
from loomrank.plans import index as indexes
from loomrank.plans import search as searches
from loomrank.schema import BLOCK_BITS

#: term, impact, documents of a small index, and a query of two tokens.
SEGMENTS = [("the", 10, [1, 4, 9]), ("the", 4, [2, 5, 6, 7, 8]), ("la", 5, [4, 7]), ("la", 3, [1, 2, 3, 8])]


@pytest.fixture(scope="module")
def small(spark):
    blocks = spark.createDataFrame([(t, i, 0, d) for t, i, d in SEGMENTS], "term string, impact int, block int, docs array<int>")
    terms = spark.createDataFrame([(1, 0, "the", 1), (1, 1, "la", 2)], "qid long, pos int, token string, weight int")
    return segments.directory(blocks), blocks, terms


@pytest.mark.parametrize(
    ("mode", "segments_read"),
    [("fixed-0", 1), ("fixed-2", 1), ("fixed-3", 2), ("fixed-4", 2), ("fixed-5", 3), ("fixed-9", 4), ("fraction-0", 1), ("fraction-0.5", 3), ("fraction-1", 4)],
)
def test_budget(small, mode, segments_read):
    directory, _, terms = small
    order = [("the", 10), ("la", 5), ("la", 3), ("the", 4)]
    got = {(r["token"], r["impact"]) for r in planning.selected(planning.planned(directory, terms), Mode.parse(mode)).collect()}
    assert got == set(order[:segments_read])


def scores(small, mode):
    directory, blocks, terms = small
    return ranking.accumulated(planning.selected(planning.planned(directory, terms), mode), blocks)


def test_scores_and_padding(spark, small):
    full = {r["doc_id"]: r["score"] for r in scores(small, Mode(fraction=1)).collect()}
    assert full == {4: 20, 1: 16, 7: 14, 2: 10, 8: 10, 9: 10, 3: 6, 5: 4, 6: 4}
    best = ranking.top_k(scores(small, Mode(fraction=1)), 4).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in best] == [(4, 20), (1, 16), (7, 14), (2, 10)]
    three = scores(small, Mode(fixed=3))
    padded = ranking.top_k(ranking.padded(three, spark.createDataFrame([(1,)], "qid long"), 6, 10), 6).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in padded] == [(4, 20), (1, 10), (7, 10), (9, 10), (0, 0), (2, 0)]
    assert scores(small, Mode(fixed=-1)).count() == 0


def test_chunks(small):
    assert [tuple(r) for r in ranking.chunk_maxima(scores(small, Mode(fraction=1))).collect()] == [(1, 0, 20)]
    assert {r["doc_id"] for r in ranking.above(scores(small, Mode(fraction=1)), 10).collect()} == {4, 1, 7}


def test_repeated_and_weightless_tokens(spark, small):
    directory, blocks, _ = small
    twice = spark.createDataFrame([(1, 0, "la", 1), (1, 1, "la", 1), (1, 2, "the", 0), (1, 3, "none", 1)], "qid long, pos int, token string, weight int")
    plan = planning.planned(directory, twice)
    assert {r["doc_id"]: r["score"] for r in ranking.accumulated(plan, blocks).collect()} == {4: 10, 7: 10, 1: 6, 2: 6, 3: 6, 8: 6}
    assert planning.postings_per_query(plan).first()["postings"] == 2 * 6 + 8
    assert [tuple(r) for r in planning.unknown(directory, twice).collect()] == [("none",)] or [r["token"] for r in planning.unknown(directory, twice).collect()] == ["none"]


def test_wrapping(spark, small):
    directory, blocks, _ = small
    heavy = spark.createDataFrame([(1, 0, "the", 7000)], "qid long, pos int, token string, weight int")
    got = {r["doc_id"]: r["score"] for r in ranking.accumulated(planning.planned(directory, heavy), blocks, wrap=True).collect()}
    assert got == {d: s for t, i, ds in SEGMENTS if t == "the" for d in ds if (s := i * 7000 % 65536)}


@pytest.mark.parametrize("bad", ["fixed", "fixed-1-2", "fixed--1", "fraction-2", "fraction-x", "all-1", ""])
def test_bad_modes(bad):
    with pytest.raises(ValueError):
        Mode.parse(bad)


@pytest.mark.parametrize("bits", [0, 16])
def test_bad_bits(bits):
    with pytest.raises(ValueError):
        LinearQuantizer(bits)


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    return [(i, " ".join(r.choice(vocabulary[: r.randint(2, 40)]) for _ in range(r.randint(1, 60)))) for i in range(n)]


def brute(rows, query, k1=0.9, b=0.4, bits=8):
    n = len(rows)
    tf = [defaultdict(int) for _ in rows]
    for i, t in rows:
        for w in t.split():
            tf[i][w] += 1
    lengths = [sum(x.values()) for x in tf]
    average = sum(lengths) / n
    df = defaultdict(int)
    for x in tf:
        for w in x:
            df[w] += 1

    def score(w, i):
        idf = max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * (1 + k1)
        return idf * tf[i][w] / (tf[i][w] + k1 * (1 - b + b * lengths[i] / average))

    top = max(score(w, i) for i in range(n) for w in tf[i])
    out = {}
    for i in range(n):
        s = sum(weight * math.ceil(score(w, i) * 2**bits / top - 1e-6) for w, weight in query if w in tf[i])
        if s:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_exhaustive_equals_a_plain_sum(spark, tmp_path):
    rows = corpus()
    built = indexes.from_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    query = [("w0", 1), ("w5", 3), ("w30", 2), ("absent", 1)]
    terms = spark.createDataFrame([(7, i, w, x) for i, (w, x) in enumerate(query)], "qid long, pos int, token string, weight int")
    got = [(r["doc_id"], r["score"]) for r in searches.search(built, terms, 1000).orderBy("rank").collect()]
    assert got == brute(rows, query)
    ranks = [got[:5], got[:1]]
    assert [[(r["doc_id"], r["score"]) for r in searches.search(built, terms, k).orderBy("rank").collect()] for k in (5, 1)] == ranks
    # a larger budget reads a prefix more, and all of it is the exhaustive search
    plan = planning.planned(built.directory, terms)
    before = set()
    for budget in (0, 5, 20, 60, 10_000):
        now = {(r["token"], r["impact"]) for r in planning.selected(plan, Mode(fixed=budget)).collect()}
        assert before <= now
        before = now
    assert len(before) == plan.count()
    path = f"file://{tmp_path}/index"
    indexes.write(built, path)
    stored = indexes.read(spark, path)
    for push in (False, True):
        assert [(r["doc_id"], r["score"]) for r in searches.search(stored, terms, 1000, push=push).orderBy("rank").collect()] == got
    assert stored.stats.first() == built.stats.first() and stored.num_docs == 60 and stored.getter("quant_bits") == 8
    assert stored.directory.count() == built.directory.count()
    assert "PushedFilters: [In(term" in searches.narrowed(stored, terms)[1]._jdf.queryExecution().toString()


def test_identity_and_top_levels(spark):
    rows = spark.createDataFrame([(0, "a a b"), (1, "a"), (2, "")], "doc_id long, text string")
    plain = indexes.from_documents(rows, Identity())
    assert {(r["term"], r["impact"], r["count"]) for r in plain.directory.collect()} == {("a", 2, 1), ("a", 1, 1), ("b", 1, 1)}
    assert plain.getter("num_postings") == 3 and plain.getter("max_doc_id") == 2 and plain.num_docs == 3
    for bits in (1, 8, 15):
        assert indexes.from_documents(rows, BM25(), bits).getter("max_level") == 2**bits


def test_ids_must_be_dense(spark):
    with pytest.raises(ValueError, match="dense"):
        indexes.from_documents(spark.createDataFrame([(0, "a"), (2, "b")], "doc_id long, text string"))


def test_long_lists_are_cut_into_blocks(spark):
    n = (1 << BLOCK_BITS) + 10
    postings = spark.range(n).selectExpr("'t' AS term", "CAST(id AS INT) AS doc_id", "3 AS impact")
    blocks = segments.blocks(postings).persist()
    assert sorted((r["block"], len(r["docs"])) for r in blocks.collect()) == [(0, 1 << BLOCK_BITS), (1, 10)]
    assert segments.joined(blocks).first()["docs"] == list(range(n)) and segments.directory(blocks).first()["count"] == n
    terms = spark.createDataFrame([(1, 0, "t", 1)], "qid long, pos int, token string, weight int")
    assert ranking.accumulated(planning.planned(segments.directory(blocks), terms), blocks).count() == n


def test_scores_above_are_computed_once(spark):
    scores = spark.range(300).selectExpr("id % 3 AS qid", "CAST(id AS INT) AS doc_id", "id % 50 AS score")
    found = ranking.above(scores, 47)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((i % 3, i, i % 50) for i in range(300) if i % 50 > 47)


def test_sums_of_a_task_are_bounded(spark, monkeypatch):
    """Queries and ranges of ids are dealt out before blocks become documents: a hot term's sums don't meet in the task that reads it."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('hot n', id % 3) AS text")
    built = indexes.from_documents(rows, Identity(), block_bits=5)
    terms = spark.createDataFrame([(q, 0, "hot", 1 + q) for q in range(20)] + [(q, 1, "n1", 2) for q in range(20)], "qid long, pos int, token string, weight int")
    monkeypatch.setattr(searches, "SUMS", 2000)
    got = searches.scores(built, terms)
    assert got.rdd.getNumPartitions() == 30
    most = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most <= 6000
    assert got.exceptAll(ranking.accumulated(planning.planned(built.directory, terms), built.blocks)).isEmpty() and got.count() == 60_000
    assert {tuple(r) for r in searches.scores(built, terms, wrap=True).collect()} == {tuple(r) for r in got.collect()}
