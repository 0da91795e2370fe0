"""The stored layout, skipping by blocks, rounds by levels, and ids of 32 bits."""

import os
import random
import re

import pytest

from loomrank import storage
from loomrank.functions.scoring import Identity
from loomrank.operators import planning, ranking, segments
from loomrank.operators.planning import Mode
from loomrank.plans import index as indexes
from loomrank.plans import rounds
from loomrank.plans import search as searches

#: Ids beyond 31 bits, as other engines store them.
WIDE = [0, 1, 127, 128, 65_535, 65_536, 2_147_483_647, 2_147_483_648, 3_000_000_000, 4_204_497_652, 4_294_967_295]
QUERY = "qid long, pos int, token string, weight int"


def rows(result):
    return sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in result.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    texts = []
    for i in range(600):
        topic = [f"t{i // 20}-{j}" for j in range(6)]
        texts.append((i, " ".join([r.choice(topic) for _ in range(r.randint(0, 30))] + [f"w{min(int(r.paretovariate(0.6)), 60)}" for _ in range(r.randint(1, 40))])))
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def batch(spark):
    r = random.Random(12)
    lines = [(q, p, f"t{q}-{p}" if p < 3 else f"w{r.randint(1, 40)}", r.randint(1, 3)) for q in range(25) for p in range(7)]
    return spark.createDataFrame([*lines, (90, 0, "absent", 1), (91, 0, "w1", 0), (92, 0, "w1", 1), (92, 1, "w1", 2)], QUERY)


@pytest.fixture(scope="module")
def fine(corpus):
    return indexes.from_documents(corpus, block_bits=4).persist()


@pytest.mark.parametrize("mode", [Mode(fraction=1.0), Mode(fraction=0.3), Mode(fixed=50), Mode(fixed=-1)])
def test_cells_give_what_segments_give(fine, batch, mode):
    plan = planning.selected(planning.planned(fine.directory, batch), mode)
    for wrap in (False, True):
        want = {(r["qid"], r["doc_id"], r["score"]) for r in ranking.accumulated(plan, fine.blocks, wrap).collect()}
        assert {(r["qid"], r["doc_id"], r["score"]) for r in searches.by_cells(fine, batch, mode, wrap).collect()} == want


@pytest.mark.parametrize(("k", "seeds"), [(1, 1), (5, 1), (10, 3), (400, 1)])
def test_skipping_equals_search_and_reads_less(fine, batch, k, seeds):
    for mode in (Mode(fraction=1.0), Mode(fraction=0.2)):
        assert rows(searches.search_skipping(fine, batch, k, mode, seeds)) == rows(searches.search(fine, batch, k, mode))
    s = searches.skipping(fine, batch, k, seeds=seeds)
    read, every = (ranking.hits(c, fine.blocks).count() for c in (s.read, s.cells))
    assert read <= every and (k > 10 or read < every / 2)


def test_ties_at_the_threshold(spark):
    # the seed block has the k-th best score; an earlier block's document has the same and a smaller id
    texts = [(i, "") for i in range(64)]
    texts[3], texts[20], texts[21], texts[40] = (3, "a a b"), (20, "a a b"), (21, "a a a c c"), (40, "a a b")
    built = indexes.from_documents(spark.createDataFrame(texts, "doc_id long, text string"), Identity(), block_bits=3)
    terms = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "c", 1)], QUERY)
    for k in (1, 2, 3, 4, 5):
        assert rows(searches.search_skipping(built, terms, k)) == rows(searches.search(built, terms, k))
    assert rows(searches.search_skipping(built, terms, 2)) == [(1, 1, 21, 5), (1, 2, 3, 3)]


def test_skipping_shuffles_a_batch_once(fine, batch):
    # bounds, masks and sums lie by query and zone as their postings do
    plan = searches.skipping(fine, batch).scores._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan


def test_counting_documents_reads_no_lists(fine):
    assert fine.num_docs == fine.getter("num_docs") == 600
    plan = fine.docs._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan  # lengths were counted once, when the index was built


@pytest.mark.parametrize("bits", [1, 4, 13, 16])
def test_skipping_by_zones_of_any_blocks(spark, bits, tmp_path):
    r = random.Random(bits)
    texts = [(r.choice((0, 60_000, 200_000)) + i, " ".join(r.choice("abcdef") for _ in range(r.randint(0, 9)))) for i in range(400)]
    texts[7] = (70_007, "a " * 40_000)  # an impact beyond 15 bits
    built = indexes.from_documents(spark.createDataFrame(texts, "doc_id long, text string"), Identity(), dense=False, block_bits=bits)
    indexes.write(built, f"file://{tmp_path}/index", buckets=2)
    terms = spark.createDataFrame([(q, p, t, 1 + p) for q, ts in enumerate(("abc", "aa", "f", "fz", "edcba")) for p, t in enumerate(ts)], QUERY)
    for mode in (Mode(fraction=1.0), Mode(fraction=0.4)):
        want = rows(searches.search(built, terms, 4, mode))
        assert want[0][2:] == (70_007, 40_000)
        for ix in (built, indexes.read(spark, f"file://{tmp_path}/index")):
            assert rows(searches.search_skipping(ix, terms, 4, mode)) == want


@pytest.mark.parametrize(("k", "worth"), [(1, 1.0), (5, 0.5), (10, 0.0), (1000, 1.0)])
def test_rounds_equal_search(fine, batch, k, worth):
    got = rounds.search_rounds(fine, batch, k, worth=worth, measured=True)
    assert rows(got.results) == rows(searches.search(fine, batch, k))
    total = planning.planned(fine.directory, batch).agg({"count": "sum"}).first()[0]
    assert got.postings <= total and got.log[0].queries >= got.log[-1].queries
    assert sum(r.left for r in got.log) == got.log[0].queries
    if k == 1:
        assert got.postings < total / 2 and len(got.log) > 1
    if not worth:
        assert [r.left for r in got.log[:-1]] == [0] * (len(got.log) - 1)


def test_rounds_without_known_tokens(spark, fine):
    assert rows(rounds.search_rounds(fine, spark.createDataFrame([(1, 0, "absent", 1)], QUERY)).results) == []


def test_rounds_shuffle_a_batch_once(fine, batch, monkeypatch):
    # what a batch has is dealt out once; sums of every round, and what leaving queries keep, lie in the same buckets
    plans = []

    def seen(df, table, *rest):
        plans.append((table, df._jdf.queryExecution().executedPlan().toString()))
        return indexes.dealt(df, table, *rest)

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return storage.saved(df, name)

    monkeypatch.setattr(rounds, "dealt", lambda df, table, n, lying=False: seen(df, table, n, lying), raising=False)
    monkeypatch.setattr(rounds, "saved", kept)
    got = rounds.search_rounds(fine, batch, 3)
    assert rows(got.results) == rows(searches.search(fine, batch, 3)) and len(got.log) > 1
    assert [t for t, _ in plans].count("zones") == 1
    sums = [p for t, p in plans if t == "scores"]
    assert len(sums) > 1 and not any("Exchange hashpartitioning" in p for p in sums)
    assert all("Bucketed: true" in p for p in sums if "HashAggregate" in p)
    assert not any(re.search(r"Exchange hashpartitioning\(qid#\d+L?, zone", p) for t, p in plans if t in ("results", "leaving"))


@pytest.mark.parametrize(("bits", "kept", "shares"), [(1, False, (1 / 16, 1 / 2)), (13, True, (1 / 3,)), (16, False, ()), (4, True, (1 / 8, 1 / 2))])
def test_rounds_by_zones_of_any_blocks(spark, bits, kept, shares, tmp_path):
    r = random.Random(bits)
    texts = [(r.choice((0, 60_000, 200_000)) + i, " ".join(r.choice("abcdef") for _ in range(r.randint(0, 9)))) for i in range(400)]
    texts[7] = (70_007, "a " * 40_000)  # an impact beyond 15 bits
    built = indexes.from_documents(spark.createDataFrame(texts, "doc_id long, text string"), Identity(), dense=False, block_bits=bits)
    if kept:
        indexes.write(built, f"file://{tmp_path}/index", buckets=2)
        built = indexes.read(spark, f"file://{tmp_path}/index")
    terms = spark.createDataFrame([(q, p, t, 1 + p) for q, ts in enumerate(("abc", "aa", "f", "fz", "edcba")) for p, t in enumerate(ts)], QUERY)
    want = rows(searches.search(built, terms, 4))
    assert want[0][2:] == (70_007, 40_000) and rows(rounds.search_rounds(built, terms, 4, shares, worth=1.0).results) == want


def test_lists_with_levels_have_the_directory(fine, batch):
    leveled = fine.leveled(batch, 6).persist()
    want = {(r["term"], r["impact"]): r["count"] for r in fine.of(batch).directory.collect()}
    assert {(r["term"], r["impact"]): r["count"] for r in segments.leveled_directory(leveled).collect()} == want
    for cut in (0, 1, 7, 300):
        n = leveled.selectExpr("*", f"{cut} AS cut").selectExpr(f"sum({segments.below('cut')}) AS n").first()["n"]
        assert n == sum(c for (_, impact), c in want.items() if impact < cut)


def test_stored_tables_meet_without_a_shuffle(spark, fine, batch, tmp_path):
    path = f"file://{tmp_path}/index"
    indexes.write(fine, path, buckets=3)
    stored = indexes.read(spark, path)
    assert stored.block_bits == 4 and rows(searches.search(stored, batch, 7)) == rows(searches.search(fine, batch, 7))
    assert stored.tops.count() == fine.tops.count()
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a batch of any size
    try:
        plan = searches.scores(stored, batch)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    # below an exchange lie the batch, the cells or the hits, never a bucketed scan by itself
    lines = plan.splitlines()
    scans = [i for i, x in enumerate(lines) if "Scan parquet" in x and "loomrank_" in x]
    assert len(scans) == 2 and "Bucketed: true" in plan
    for i in scans:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-*0123456789()|"))
        above = next(x for x in reversed(lines[:i]) if "Join" in x or "Exchange" in x)
        assert "Join" in above, (depth, above)


def test_incomplete_indexes_are_refused(spark, fine, tmp_path):
    path = f"{tmp_path}/index"
    indexes.write(fine, f"file://{path}")
    with pytest.raises(Exception, match="(?i)exist"):
        indexes.write(fine, f"file://{path}")
    indexes.read(spark, f"file://{path}")
    part = sorted(x for x in os.listdir(f"{path}/blocks") if x.startswith("part"))[0]
    os.rename(f"{path}/blocks/{part}", f"{tmp_path}/kept")
    with pytest.raises(storage.Incomplete, match="blocks"):
        indexes.read(spark, f"file://{path}")
    os.rename(f"{tmp_path}/kept", f"{path}/blocks/{part}")
    indexes.read(spark, f"file://{path}")
    os.rename(f"{path}/manifest", f"{path}/away")
    with pytest.raises(storage.Incomplete, match="no manifest"):
        indexes.read(spark, f"file://{path}")


def test_ids_of_32_bits(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"all n{n} " + ("odd" if n % 2 else "")) for n, i in enumerate(WIDE)], "doc_id long, text string")
    built = indexes.from_documents(docs, Identity(), dense=False, wide=True)
    indexes.write(built, f"file://{tmp_path}/wide")
    for ix in (built, indexes.read(spark, f"file://{tmp_path}/wide")):
        terms = spark.createDataFrame([(1, 0, "all", 1), (2, 0, "odd", 1), (3, 0, "n8", 2)], QUERY)
        got = searches.search(ix, terms, 100)
        assert got.schema["doc_id"].dataType.simpleString() == "bigint"
        assert [r["doc_id"] for r in got.where("qid = 1").orderBy("rank").collect()] == WIDE
        assert [r["doc_id"] for r in got.where("qid = 2").orderBy("rank").collect()] == WIDE[1::2]
        assert [(r["doc_id"], r["ext_id"], r["score"]) for r in got.where("qid = 3").collect()] == [(3_000_000_000, "3000000000", 2)]
        assert sorted(segments.joined(ix.blocks).where("term = 'all'").first()["docs"]) == WIDE
    for bad in (1 << 32, -1):
        with pytest.raises(Exception, match="32 bits"):
            indexes.from_documents(spark.createDataFrame([(bad, "a")], "doc_id long, text string"), Identity(), dense=False, wide=True).blocks.collect()


def test_offsets_take_two_bytes(fine):
    assert fine.blocks.schema["docs"].dataType.elementType.simpleString() == "smallint"
    assert segments.absolute(fine.blocks).schema["docs"].dataType.elementType.simpleString() == "int"


def test_a_warm_batch_without_budget_reads_no_storage(spark, fine, batch, tmp_path):
    path = f"{tmp_path}/index"
    indexes.write(fine, f"file://{path}")
    stored = indexes.read(spark, f"file://{path}")
    modes = [Mode(fixed=0), Mode(fixed=-1), Mode(fraction=0.3), Mode(fraction=1.0)]
    want = [rows(searches.search(fine, batch, 8, m)) for m in modes]
    warm = searches.warmed(stored, batch)
    assert [rows(searches.search(stored, batch, 8, m, warm=warm)) for m in modes] == want
    other = spark.createDataFrame([(1, 0, "w1", 1), (1, 1, "t3-1", 2), (1, 2, "t29-5", 1)], QUERY)  # not all of it was warmed
    assert rows(searches.search(stored, other, 8, warm=warm)) == rows(searches.search(fine, other, 8))
    os.rename(path, f"{path}-away")
    assert rows(searches.search(stored, batch, 8, Mode(fixed=0), warm=warm)) == want[0]
    with pytest.raises(Exception, match="(?i)exist|not found|no such"):
        searches.search(stored, batch, 8, warm=warm).collect()
    os.rename(f"{path}-away", path)
    warm.unpersist()


def test_codecs_change_bytes_and_nothing_else(spark, fine, batch, tmp_path):
    paths = {c: f"file://{tmp_path}/{c}" for c in ("uncompressed", "zstd")}
    for codec, path in paths.items():
        indexes.write(fine, path, buckets=2, codecs={"blocks": codec, "tops": codec})
    one, two = (indexes.read(spark, p) for p in paths.values())
    assert rows(searches.search(one, batch)) == rows(searches.search(two, batch)) == rows(searches.search(fine, batch))
    plain, packed = (indexes.stored_bytes(spark, p) for p in paths.values())
    assert set(plain) == set(indexes.TABLES) and packed["blocks"] < plain["blocks"] and packed["tops"] < plain["tops"]
    with pytest.raises(ValueError, match="no such tables"):
        indexes.write(fine, f"file://{tmp_path}/x", codecs={"postings": "zstd"})


def test_the_directory_needs_no_shuffle_of_its_own(fine, batch):
    for df in (fine.directory, fine.tops, fine.blocks):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan or "Exchange" not in plan
        assert "Exchange" not in plan
    assert {r["term"] for r in fine.of(batch).directory.collect()} == {r["term"] for r in fine.directory.collect()} & {r["token"] for r in batch.collect()}
    assert fine.terms.distinct().count() == fine.directory.select("term").distinct().count()
