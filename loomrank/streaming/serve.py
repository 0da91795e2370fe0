"""Requests that keep coming, answered over a static index.

The running total behind a budget and the ranks aren't allowed on streams, so each
micro-batch is searched as a batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomrank.operators import planning, ranking
from loomrank.operators.planning import Mode
from loomrank.plans.index import Index
from loomrank.sources import requests
from loomrank.storage import saved

Sink = Callable[[DataFrame, int], None]


def answered(index: Index, rows: DataFrame, column: str = "value", numbered: bool = False) -> DataFrame:
    """results of a batch of JSON requests, each with its own k and mode: qid, rank, doc_id, ext_id, score.

    Every request is answered by itself, whatever other requests have its id;
    numbered: with its number within the batch.
    """
    return _answered(index, saved(requests.parsed(rows, column), "requests"), numbered)  # numbered once, whatever the rows come from


def _answered(index: Index, parsed: DataFrame, numbered: bool) -> DataFrame:
    valid = parsed.where("error IS NULL")
    wanted = valid.select(F.col("request").alias("qid"), "k", "rho", F.col("budget").alias("fixed"))
    names = valid.select("request", F.col("qid").alias("name"))
    index = index.of(requests.query_terms(parsed))
    plan = planning.with_prior(planning.planned(index.directory, requests.query_terms(parsed))).join(wanted, "qid")
    share = F.ceil(F.col("total").cast("float") * F.col("rho").cast("float"))
    budget = F.when(F.col("rho") == 1, F.col("total")).otherwise(F.coalesce(share, "fixed"))
    found = ranking.summed(ranking.hits(planning.cells(planning.cuts(plan.where(F.col("prior") <= budget)), index.tops), index.blocks))
    most = wanted.agg(F.max("k")).first()[0] or 1
    ranked = ranking.top_k(found, most).join(wanted.select("qid", "k"), "qid").where("rank <= k")
    out = ranking.named(ranked, index.docs).withColumnRenamed("qid", "request").join(names, "request").withColumnRenamed("name", "qid")
    return out.select(*(["request"] if numbered else []), "qid", "rank", "doc_id", "ext_id", "score")


def timed(index: Index, rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Answers of a batch of arrivals (nth, arrived and the request), and a row per request: nth, arrived, server and user.

    server: microseconds that its batch took; user: those since it fell due.  Both
    are null for a request that can't be served.
    """
    began = time.time()
    parsed = saved(requests.parsed(rows, column, ["nth", "arrived"]), "requests")
    answers = saved(_answered(index, parsed, True).join(parsed.select("request", "nth"), "request").drop("request"), "answers")
    ended = time.time()
    fine = F.col("error").isNull()
    server = F.when(fine, F.lit(round((ended - began) * 1e6)).cast("double")).alias("server")
    user = F.when(fine, F.lit(ended * 1e6) - F.unix_micros("arrived")).cast("double").alias("user")
    return answers, parsed.select("nth", "arrived", server, user)


def serve(index: Index, stream: DataFrame, sink: Sink, column: str = "value", checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Answers a stream of JSON requests; sink(results, batch id) gets each micro-batch's results."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            sink(answered(index, rows, column), number)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def replay(index: Index, query_terms: DataFrame, tps: int, seconds: float, k: int = 10, mode: Mode = planning.EXHAUSTIVE) -> list[tuple[int, float]]:
    """Queries at a fixed rate from Spark's rate source, cycled: (queries answered, seconds) of each micro-batch.

    A query that comes twice in a micro-batch is searched twice.
    """
    from loomrank.plans.search import search

    spark = query_terms.sparkSession
    ids = [r[0] for r in query_terms.select("qid").distinct().orderBy("qid").collect()]  # the query file's ids
    log: list[tuple[int, float]] = []

    def batch(rows: DataFrame, number: int) -> None:
        began = time.perf_counter()
        n = rows.count()
        if n and ids:
            nth = rows.select("value", F.element_at(F.array(*(F.lit(i) for i in ids)), (F.col("value") % len(ids) + 1).cast("int")).alias("qid"))
            asked = query_terms.join(nth, "qid").select(F.col("value").alias("qid"), "pos", "token", "weight")
            search(index, asked, k, mode).count()
            log.append((n, time.perf_counter() - began))

    query = spark.readStream.format("rate").option("rowsPerSecond", tps).load().writeStream.foreachBatch(batch).start()
    query.awaitTermination(int(seconds))
    query.stop()
    return log
