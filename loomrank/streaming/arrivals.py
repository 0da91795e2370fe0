"""Requests that arrive at a fixed rate, cycling through a stored list: a streaming source with offsets of its own.

The n-th request is due at origin + n / tps, whoever asks and whenever, so an offset
is just a number.  After a restart the source goes on where the checkpoint ended: what
fell due meanwhile comes at once and keeps the time at which it was due, and nothing
comes twice.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from loomrank.sources.ciff import store

SCHEMA = "nth long, arrived timestamp, value string"
#: Requests of a task at most.
SPLIT = 10_000
_lists: dict[str, list[str]] = {}


def stored(requests: DataFrame, path: str, column: str = "value") -> str:
    """Writes a list of requests, in the order of their text, where arrivals() finds it; a list is as large as a query file."""
    requests.select(column).toDF("value").coalesce(1).sortWithinPartitions("value").write.parquet(path)
    return path


def _list(path: str) -> list[str]:
    if path not in _lists:
        system, at = store(path)
        _lists[path] = pq.read_table(at, filesystem=system, columns=["value"])["value"].to_pylist()
    return _lists[path]


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.tps, self.origin = options["path"], float(options["tps"]), float(options["origin"])
        self.most = int(options["limit"]) if "limit" in options else None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        due = max(0, int((time.time() - self.origin) * self.tps))
        return {"n": due if self.most is None else min(due, self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(a, min(a + SPLIT, end["n"])) for a in range(start["n"], end["n"], SPLIT)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        requests = _list(self.path)
        for n in range(partition.start, partition.end) if requests else ():
            yield n, dt.datetime.fromtimestamp(self.origin + n / self.tps, dt.UTC), requests[n % len(requests)]


class Arrivals(DataSource):
    """spark.readStream.format("arrivals").option("tps", …).option("origin", seconds).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str | StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def arrivals(spark: SparkSession, path: str, tps: float, origin: float | None = None, limit: int | None = None) -> DataFrame:
    """nth, arrived and value of a stored list's requests, `tps` of them a second from `origin` on (seconds since 1970; now), `limit` altogether.

    A run that is to go on after a restart has to give the same origin again.
    """
    spark.dataSource.register(Arrivals)
    reader = spark.readStream.format("arrivals").option("tps", tps).option("origin", repr(time.time() if origin is None else origin))
    return (reader if limit is None else reader.option("limit", limit)).load(path)
