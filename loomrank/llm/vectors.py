"""What the vector searches share: reading vectors, blocks of candidates, chunks of queries, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm import scratch

#: Rows of a block at most, and numbers in a chunk of queries that is sent to all tasks.
BLOCK, CHUNK = 1 << 16, 1 << 19
#: Queries that come to the driver at a time.
ROWS = 4096


def matrix(column: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows (double) of the vectors that are whole: not null, without null or non-finite components; short ones get zeros."""
    if isinstance(column, pa.ChunkedArray):
        column, ids = column.combine_chunks(), ids.combine_chunks()
    size = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    good = np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
    good[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return np.asarray(ids.fill_null(0))[good].astype(np.int64), out[good]


def fitted(x: np.ndarray, dims: int) -> np.ndarray:
    """Rows cut or filled with zeros to so many components."""
    if x.shape[1] >= dims:
        return x[:, :dims]
    return np.hstack([x, np.zeros((len(x), dims - x.shape[1]))])


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, n = [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        dims = max(x.shape[1] for x in rows)
        return np.concatenate(ids), np.concatenate([fitted(x, dims) for x in rows])

    for batch in batches:
        names, values = matrix(batch.column(1), batch.column(0))
        for s in range(0, len(names), most):
            ids.append(names[s : s + most])
            rows.append(values[s : s + most])
            n += len(ids[-1])
            if n >= most:
                yield made()
                ids, rows, n = [], [], 0
    if n:
        yield made()


def searched(
    vectors: DataFrame, is_query: Column, found: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str, order: Column, k: int,
    usable: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """The k best of all candidates for every query: query_id, rank, vec_id, score.

    vectors: vec_id and embedding.  Of sound vectors with one query id the least asks.  Queries go out in chunks of bounded size, each
    to all blocks of candidates; found(ids, rows, query ids, queries) returns the
    best of a block as (index of query, vec_id, score).
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    queries = scratch.saved(vectors.where(is_query & F.col("embedding").isNotNull() & sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    last: DataFrame | None = None
    done = None  # what all chunks but the last have found, in files: the plan stays one scan whatever the number of chunks
    ids, rows, held = [], [], 0

    def send() -> None:
        nonlocal last, done
        dims = max(x.shape[1] for x in rows)
        names, values = np.concatenate(ids), np.concatenate([fitted(x, dims) for x in rows])
        if len(names):
            if last is not None:
                done = done or scratch.new_path(spark, "found")
                last.write.mode("append").parquet(done)
            sent = spark.sparkContext.broadcast((names, values))
            last = vectors.mapInArrow(_best(sent, found, kind, usable), f"query_id long, vec_id long, score {kind}")

    for part in _partitions(queries):
        names, values = matrix(part.column(1), part.column(0))
        fine = usable(values)
        ids.append(names[fine])
        rows.append(values[fine])
        held += values.size
        if held >= CHUNK:
            send()
            ids, rows, held = [], [], 0
    if rows:
        send()
    if last is None:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    every = spark.read.schema(last.schema).parquet(done).unionByName(last) if done else last
    best = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _partitions(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries, ROWS at a time."""
    rows = []
    for r in queries.toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) >= ROWS:
            yield _table(rows)
            rows = []
    if rows:
        yield _table(rows)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["vec_id", "embedding"])


def _best(sent, found, kind: str, usable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        for ids, rows in blocks(batches):
            fine = usable(rows)
            ids, rows = ids[fine], rows[fine]
            if not len(ids):
                continue
            dims = max(rows.shape[1], queries.shape[1])
            q, vec, score = found(ids, fitted(rows, dims), names, fitted(queries, dims))
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(vec.astype(np.int64)), pa.array(score, pa.int64() if kind == "long" else pa.float64())], ["query_id", "vec_id", "score"])

    return run
