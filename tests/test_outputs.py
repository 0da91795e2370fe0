import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomrank import cli
from loomrank.functions import codec
from loomrank.operators import encoding, latency
from loomrank.plans import index as indexes
from loomrank.plans import search as searches
from loomrank.plans import throughput
from loomrank.sinks import runs
from loomrank.sources import ciff, query_lines
from loomrank.streaming import serve


@pytest.fixture(scope="module")
def built(spark):
    rows = [(i, " ".join(["the"] * (i % 4) + [f"w{i % 7}", "la", f"x{i}"])) for i in range(50)]
    return indexes.from_documents(spark.createDataFrame(rows, "doc_id long, text string")).persist()


@pytest.fixture(scope="module")
def results(spark, built):
    terms = query_lines.from_lines(spark.createDataFrame([("1:the la",), ("2:w3 the",)], "value string"))
    return searches.search(built, terms, 3).persist()


def test_run_files(spark, results, tmp_path):
    rows = results.orderBy("qid", "rank").collect()
    assert [r["value"] for r in runs.trec(results, "tag").orderBy("qid", "rank").collect()] == [f"{r['qid']} Q0 {r['ext_id']} {r['rank']} {r['score']} tag" for r in rows]
    assert [r["value"] for r in runs.tsv(results).orderBy("qid", "rank").collect()] == [f"{r['qid']} {r['ext_id']} {r['rank']}" for r in rows]
    runs.write(runs.trec(results), f"file://{tmp_path}/run")
    lines = [x for p in sorted((tmp_path / "run").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == [f"{r['qid']} Q0 {r['ext_id']} {r['rank']} {r['score']} loomrank" for r in rows]


def test_responses(results):
    one = [r for r in results.orderBy("rank").collect() if r["qid"] == 1]
    shown = runs.display(results, 12).where("qid = 1").first()["value"]
    assert shown == "query 1 took: 12ms [" + ",".join(f"#{r['rank']},({r['doc_id']},{r['score']})" for r in one) + "]"
    body = json.loads(runs.json(results, 1_500_002).where("qid = 1").first()["value"])
    assert body == {"topk": [{"doc_id": r["doc_id"], "score": r["score"]} for r in one], "took": {"secs": 1, "nanos": 500_002_000}, "qid": 0}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 101, 1000, 2009])
def test_nearest_rank(spark, n):
    values = np.random.default_rng(n).integers(0, 50 if n % 2 else 10**6, n)
    row = latency.summary(spark.createDataFrame([(int(v),) for v in values], "t long"), "t").first()
    ordered = np.sort(values)
    assert [row[p] for p in latency.SHARES] == [ordered[int(np.float32(n) * np.float32(q))] for q in latency.SHARES.values()]
    assert (row["samples"], row["max"], row["mean"]) == (n, ordered[-1], pytest.approx(values.mean()))


def test_no_samples_and_warmup(spark):
    assert latency.summary(spark.createDataFrame([(None,)], "t long"), "t").first()["samples"] == 0
    assert [r["id"] for r in latency.without_warmup(spark.range(1005), "id").collect()] == [1001, 1002, 1003, 1004]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**31 - 1), min_size=1, max_size=400, unique=True))
def test_gaps_round_trip_and_sizes(spark, ids):
    ids = sorted(ids)
    blocks = {}
    for i in ids:
        blocks.setdefault(i >> 16, []).append(i)
    df = spark.createDataFrame([("t", 1, b, d) for b, d in blocks.items()], "term string, impact int, block int, docs array<int>")
    gaps = encoding.with_gaps(df)
    back = sorted(encoding.restored(gaps).collect(), key=lambda r: r["block"])
    assert [x for r in back for x in r["docs"]] == ids
    differences = np.diff([0, *ids])
    expected = 0
    for s in range(0, len(ids), 128):
        part = differences[s : s + 128].tolist()
        expected += 1 + 16 * max(x.bit_length() for x in part) if len(part) == 128 else -(-len(part) // 4) + sum(max(1, -(-x.bit_length() // 8)) for x in part)
    row = encoding.segment_sizes(gaps).first()
    assert (row["count"], row["bytes"], row["plain_bytes"]) == (len(ids), expected, 4 * len(ids))


@pytest.mark.parametrize("n", [127, 128, 129, 8191, 8192, 8193])
def test_block_edges(spark, n):
    df = spark.createDataFrame([("t", 1, 0, list(range(n)))], "term string, impact int, block int, docs array<int>")
    sizes = encoding.block_sizes(encoding.with_gaps(df))
    assert sizes.count() == -(-n // codec.BLOCK_LEN) and sizes.agg(F.sum("count")).first()[0] == n


def test_streamed_requests(spark, built, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    request = {"query": {"id": 1, "tokens": [{"token": "the", "freq": 1}]}, "k": 2, "query_mode": {"Fraction": 1.0}}
    fixed = {"query": {"id": 2, "tokens": [{"token": "la", "freq": 1}, {"token": "the", "freq": 2}]}, "k": 4, "query_mode": {"Fixed": 0}}
    (folder / "a.json").write_text("\n".join(map(json.dumps, [request, fixed])) + "\nbroken\n")
    got = []
    query = serve.serve(built, spark.readStream.text(f"file://{folder}"), lambda rows, n: got.extend(map(tuple, rows.collect())))
    query.awaitTermination(120)
    terms = spark.createDataFrame([(1, 0, "the", 1)], "qid long, pos int, token string, weight int")
    expected = [tuple(r) for r in searches.search(built, terms, 2).orderBy("rank").collect()]
    assert sorted(r for r in got if r[0] == 1) == sorted(expected)
    terms = spark.createDataFrame([(2, 0, "la", 1), (2, 1, "the", 2)], "qid long, pos int, token string, weight int")
    assert sorted(r for r in got if r[0] == 2) == sorted(tuple(r) for r in searches.fixed(built, terms, 0, 4).collect())


def test_replay_and_rates(spark, built):
    terms = query_lines.from_lines(spark.createDataFrame([("1:the",), ("2:la",)], "value string"))
    assert sum(n for n, _ in serve.replay(built, terms, 20, 6)) > 0
    seconds, rows = throughput.run_batch(built, terms, 5)
    assert seconds > 0 and rows == 10
    assert len(throughput.load(lambda tps: tps, 5, 0.2)) >= 1
    best, got = throughput.highest_rate(lambda tps: min(tps, 430))
    assert 430 <= best <= 500 and got == 430


def test_command_line(spark, tmp_path, capsys):
    lists = [("a", [(0, 2), (1, 1)]), ("b", [(1, 3)])]
    (tmp_path / "x.ciff").write_bytes(ciff.encode(lists, [(0, "D0", 2), (1, "D1", 4)]))
    (tmp_path / "q").write_text("1:a b\n2:b\n")
    assert cli.main(["create", "--input", str(tmp_path / "x.ciff"), "--output", f"{tmp_path}/ix"]) == 0
    run = ["query", "--index", f"{tmp_path}/ix", "--queries", f"{tmp_path}/q", "--mode", "fraction-1", "--output-file", f"{tmp_path}/run", "--warmup", "--num-queries", "5"]
    assert cli.main(run) == 0 and "2 queries" in capsys.readouterr().out
    lines = sorted(x for p in (tmp_path / "run").glob("part*") for x in p.read_text().splitlines())
    assert lines == ["1 Q0 D0 2 2 loomrank", "1 Q0 D1 1 4 loomrank", "2 Q0 D1 1 3 loomrank"]
