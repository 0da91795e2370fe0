import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.llm import bit_sliced, prefix_forest


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:160] = x[100]  # ties
    x[200] = 0
    out = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    out += [(700, None), (701, []), (702, [1.0, None] + [0.0] * 14), (703, [math.nan] * 16), (704, [math.inf] * 16), (705, [0.5]), (706, [1e9] * 16), (710, [1e5] * 8 + [-3.0] * 8), (711, [-1e14] + [0.0] * 15), (301, [0.25] * 16), (301, [0.5] * 16), *((350, [x] * 16) for x in (0.25, 0.5, 0.125, 1.0, 2.0, 3.0, 4.0)), (None, [1.0] * 16), (750, [-1e-300] + [0.0] * 15)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(5)


def whole(rows):
    return {i: np.array(list(v) + [0.0] * (16 - len(v)), np.float32).astype(float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}


def every(rows):
    return [(i, v) for one in rows for i, v in whole([one]).items()]


def test_exact_top_k(table, rows):
    candidates = [(i, [math.floor(256 * x) for x in v]) for i, v in every(rows)]
    vectors = {}
    for i, v in every(rows):  # of a query's vectors the least one asks
        if i not in vectors or v.tolist() < vectors[i][0]:
            vectors[i] = v.tolist(), [math.floor(256 * x) for x in v]
    got = {}
    for r in bit_sliced.top_k(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in vectors if i % 50 == 0]
    assert sorted(got) == sorted(queries) and 100 in queries and 750 in queries
    for q in queries:
        best = sorted((-sum(a * b for a, b in zip(vectors[q][1], v)), i) for i, v in candidates if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_sliced_sums_are_exact_without_drops():
    r = np.random.default_rng(5)
    values = r.integers(-300, 300, size=(130, 9))
    index = bit_sliced.Index(values, drop=0)
    for query in [*r.integers(-40, 40, size=(6, 9)), np.zeros(9, np.int64)]:
        bits = np.unpackbits(index.sums(query).view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
        base, error = index.offset(query)
        assert error == 0 and (base + (bits << np.arange(len(bits))[:, None]).sum(0) == values @ query).all()
        assert {int(i) for i in np.argsort(-(values @ query), kind="stable")[:4]} <= set(index.top(query, 4).tolist())


def test_neighbours(table, rows):
    rows = [r for r in rows if r[0] not in (301, 350)] + [(301, [0.5] * 16), (350, [2.0] * 16)]
    vectors = {i: v for i, v in whole(rows).items() if (v != 0).any()}
    table = table.where("vec_id not in (301, 350)").unionByName(table.where("vec_id = 301 and get(embedding, 1) = 0.5 or vec_id = 350 and get(embedding, 0) = 2"))
    got = {}
    for r in prefix_forest.neighbours(table, F.col("vec_id") % 25 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in vectors if i % 25 == 0]
    assert sorted(got) == sorted(queries) and 200 not in got
    hits = 0
    for q in queries:
        found = sorted(got[q])
        assert [n for n, *_ in found] == list(range(1, 11)) and q not in [i for _, i, _ in found]
        for _, i, d in found:
            assert d == pytest.approx(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()), abs=1e-12)
        assert [(d, i) for _, i, d in found] == sorted((d, i) for _, i, d in found)
        best = sorted((np.sqrt(((v - vectors[q]) ** 2).sum()), i) for i, v in vectors.items() if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(queries)
    assert [i for _, i, _ in sorted(got[100])] == list(range(101, 111)), "equal vectors: the smallest ids"


def test_neighbours_of_an_id_that_repeats(table):
    got = [tuple(r) for r in prefix_forest.neighbours(table, F.col("vec_id") == 350).collect()]
    assert sorted(n for _, n, *_ in got) == list(range(1, 11)) and all(i != 350 for *_, i, _ in got)


def test_few_and_no_rows(spark, table):
    few = table.where("vec_id in (0, 50, 3)")
    assert bit_sliced.top_k(few, F.col("vec_id") % 50 == 0).count() == 4
    assert prefix_forest.neighbours(few, F.col("vec_id") % 50 == 0).count() == 4
    assert bit_sliced.top_k(few.limit(0), F.lit(True)).count() == 0 and prefix_forest.neighbours(few.where("vec_id = 3"), F.lit(True)).count() == 0


def test_chunks_of_queries_give_the_same(table, monkeypatch):
    from loomrank.llm import vectors

    whole_ = sorted(map(tuple, bit_sliced.top_k(table, F.expr("vec_id % 2 = 0 and vec_id not in (706, 710)")).collect()))
    monkeypatch.setattr(vectors, "CHUNK", 64)
    monkeypatch.setattr(vectors, "ROWS", 90)
    assert sorted(map(tuple, bit_sliced.top_k(table, F.expr("vec_id % 2 = 0 and vec_id not in (706, 710)")).collect())) == whole_
