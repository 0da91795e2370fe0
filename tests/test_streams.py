"""Arrivals with offsets of their own, answers once each, and latencies by window."""

import random
import time

import pytest

from loomrank.functions.scoring import Identity
from loomrank.operators import latency
from loomrank.plans import index as indexes
from loomrank.streaming import arrivals, serve
from loomrank.streaming import latency as windows

GOOD = '{"query": {"id": %d, "tokens": [{"token": "a", "freq": 1}]}, "k": 2, "query_mode": {"Fraction": 1.0}}'
BAD = '{"query": {"id": 9, "tokens": [{"token": "a", "freq": 1}]}, "k": 0, "query_mode": {"Fraction": 1.0}}'


@pytest.fixture(scope="module")
def built(spark):
    return indexes.from_documents(spark.createDataFrame([(0, "a b"), (1, "a a"), (2, "b")], "doc_id long, text string"), Identity())


def test_a_restart_goes_on_at_its_offset(spark, built, tmp_path):
    listed = arrivals.stored(spark.createDataFrame([(GOOD % 1,), (GOOD % 2,), (BAD,)], "value string"), f"file://{tmp_path}/list")
    origin = time.time() - 50  # 100 a second: the whole run has fallen due
    seen, answers, times = [], [], []

    def run(limit: int) -> None:
        def batch(rows, number):
            found, took = serve.timed(built, rows)
            answers.extend(found.select("nth", "qid", "rank", "doc_id").collect())
            times.extend(took.collect())
            seen.append(number)

        stream = arrivals.arrivals(spark, listed, 100, origin, limit)
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"file://{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()

    run(40)
    assert sorted(r["nth"] for r in times) == list(range(40))
    run(100)  # a new query on the same checkpoint
    assert sorted(r["nth"] for r in times) == list(range(100)) and len(set(seen)) == len(seen)
    want = sorted([GOOD % 1, GOOD % 2, BAD])
    for r in times:
        fails = want[r["nth"] % 3] == BAD
        assert (r["user"] is None) == (r["server"] is None) == fails
        assert r["arrived"].timestamp() == pytest.approx(origin + r["nth"] / 100, abs=1e-3)
        if not fails:
            assert r["user"] > r["server"] > 0 and r["user"] > (50 - r["nth"] / 100) * 1e6
    got = sorted((r["nth"], r["rank"], r["doc_id"]) for r in answers)
    assert got == sorted((n, k, d) for n in range(100) if want[n % 3] != BAD for k, d in ((1, 1), (2, 0)))


def test_nothing_is_due_before_the_origin(tmp_path):
    r = arrivals._Reader({"path": "x", "tps": "10", "origin": repr(time.time() + 60)})
    assert r.latestOffset() == {"n": 0} and r.partitions({"n": 0}, {"n": 0}) == []
    r = arrivals._Reader({"path": "x", "tps": "10", "origin": "0", "limit": "25000"})
    assert r.latestOffset() == {"n": 25_000}
    assert [(p.start, p.end) for p in r.partitions({"n": 7}, {"n": 25_000})] == [(7, 10_007), (10_007, 20_007), (20_007, 25_000)]


def test_windows_equal_the_summary_of_their_rows(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"2024-03-01 00:{i // 60 % 60:02d}:{i % 60:02d}", float(r.randint(1, 40)) if r.random() < 0.9 else None, r.random() * 1e6) for i in range(1500)]
    times = spark.createDataFrame(rows, "at string, server double, user double").selectExpr("CAST(at AS TIMESTAMP) AS at", "server", "user")
    batch = {(w["began"], w["kind"]): w for w in windows.summaries(windows.counted(times, "at", ["server", "user"], "5 minutes", "1 minute")).collect()}
    assert len(batch) == 10
    for (began, kind), w in batch.items():
        own = times.where(f"window(at, '5 minutes').start = TIMESTAMP '{began}'")
        want = latency.summary(own, kind).first()
        assert all(w[c] == want[c] for c in ("samples", *latency.SHARES, "max")) and w["mean"] == pytest.approx(want["mean"])
        assert w["errors"] == own.where(f"{kind} IS NULL").count()
    times.repartition(4).write.parquet(f"{tmp_path}/times")
    for whole in (True, False):
        got = {}
        stream = spark.readStream.schema(times.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/times")
        query = windows.watched(stream, "at", ["server", "user"], lambda rows, _: got.update({(w["began"], w["kind"]): w for w in rows.collect()}), "5 minutes", "1 hour", whole, f"{tmp_path}/c{whole}")
        query.awaitTermination()
        assert got == (batch if whole else {})  # with an hour's patience no window is closed yet
    got = {}
    stream = spark.readStream.schema(times.schema).parquet(f"{tmp_path}/times")
    windows.watched(stream, "at", ["server", "user"], lambda rows, _: got.update({(w["began"], w["kind"]): w for w in rows.collect()}), "5 minutes", "1 second").awaitTermination()
    assert len(got) >= 8 and all(batch[key] == w for key, w in got.items())


def test_all_results_failed(spark):
    times = spark.createDataFrame([("2024-03-01 00:00:00", None)], "at string, server double").selectExpr("CAST(at AS TIMESTAMP) AS at", "server")
    (w,) = windows.summaries(windows.counted(times, "at", ["server"], "5 minutes", "1 minute")).collect()
    assert w["samples"] == 0 and w["errors"] == 1 and w["p50"] is w["max"] is w["mean"] is None
