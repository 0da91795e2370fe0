"""Gaps and back."""

import time

from pyspark.sql import functions as F

from loomrank.functions import codec


def test_long_lists_are_restored_in_proportion(spark):
    rows = spark.range(9).select(F.element_at(F.array(*map(F.lit, (0, 1, 2, 127, 128, 129, 256, 1000, 60_000))), F.col("id").cast("int") + 1).alias("n"), F.lit(7).alias("before"))
    ids = F.when(F.col("n") > 0, F.expr("transform(sequence(1, n), i -> 7 + 3L * i + i % 2)")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("ids", ids).localCheckpoint()
    rows = rows.withColumn("gaps", codec.gaps(F.col("ids"), F.col("before")))
    began = time.time()
    assert all(r["got"] == r["ids"] for r in rows.select("ids", codec.restored(F.col("gaps"), F.col("before")).alias("got")).collect())
    # 16 lists of 60,000: by squares, 29 thousand million steps
    rows = rows.where("n = 60000").crossJoin(spark.range(16)).select(F.size(codec.restored(F.col("gaps"), F.col("before"))).alias("n"))
    assert rows.agg(F.sum("n")).first()[0] == 960_000 and time.time() - began < 60
