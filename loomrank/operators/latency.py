"""Summaries of measured times."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
#: Results that a load run leaves out at its start.
SKIPPED = 1001


def nearest_ranks(n: int) -> dict[str, int]:
    """The positions (from 0) of the percentiles among n sorted values; the product is in single precision."""
    return {name: min(n - 1, int(np.float32(n) * np.float32(p))) for name, p in SHARES.items()}


def summary(times: DataFrame, column: str) -> DataFrame:
    """One row: samples, p50, p90, p99, p999, max and mean; percentiles are values that occur.

    Values are counted, dealt by ranges, and each range's total (one number a
    partition) tells in which range a rank lies; only those ranges are walked.
    """
    rows = times.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    plain = [F.count("x").alias("samples"), F.max("x").alias("max"), F.avg("x").alias("mean")]
    counts = rows.groupBy("x").agg(F.count("*").alias("n")).repartitionByRange("x").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    before, total = {}, 0
    for part, n in sorted(counts.groupBy("part").agg(F.sum("n")).collect()):
        before[part] = total
        total += n
    if not total:
        counts.unpersist()
        return rows.agg(*plain[:1], *(F.max("x").alias(p) for p in SHARES), *plain[1:])
    ranks = nearest_ranks(total)
    where = {name: max(p for p in before if before[p] <= r) for name, r in ranks.items()}
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    walked = counts.where(F.col("part").isin(*set(where.values()))).withColumn("upto", upto)
    found = walked.agg(*(F.min(F.when((F.col("part") == where[p]) & (F.col("upto") > ranks[p] - before[where[p]]), F.col("x"))).alias(p) for p in SHARES)).first()
    counts.unpersist()
    kind = rows.schema["x"].dataType
    return rows.agg(plain[0], *(F.lit(found[p]).cast(kind).alias(p) for p in SHARES), *plain[1:])


def without_warmup(times: DataFrame, order: str, skipped: int = SKIPPED) -> DataFrame:
    """All but the first results of one run, by a column without nulls; only results that tie with the last one left out are numbered."""
    first = times.select(order).orderBy(order).limit(skipped)
    cut, = first.agg(F.max(order)).first()
    if cut is None:
        return times
    out = first.where(F.col(order) == cut).count()
    ties = times.where(F.col(order) == cut).withColumn("nth", F.row_number().over(Window.orderBy(order))).where(F.col("nth") > out).drop("nth")
    return times.where(F.col(order) > cut).unionByName(ties)
