"""Times of a stream, summed up window by window.

The state of a stream is how often each value occurred in each window, so the
percentiles of a window are exact however many results it has, and a restart goes on
with the counts of its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from loomrank.operators.latency import SHARES

Sink = Callable[[DataFrame, int], None]


def counted(times: DataFrame, at: str, columns: list[str], width: str, late: str) -> DataFrame:
    """began, kind (a column's name), x and n: how often each value occurs in each window of `at`; a null value is a result that failed."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("x")) for c in columns)))
    times = times.withColumn(at, F.col(at).cast("timestamp"))  # watermarks need an instant
    rows = times.withWatermark(at, late) if times.isStreaming else times
    rows = rows.select(F.col(at), kinds.alias("v")).groupBy(F.window(at, width).alias("w"), F.col("v.kind").alias("kind"), F.col("v.x").alias("x")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("began"), "kind", "x", "n")


def summaries(counts: DataFrame) -> DataFrame:
    """began, kind, samples, errors, the percentiles by nearest rank, max and mean of every window."""
    own = Window.partitionBy("began", "kind")
    found = F.col("x").isNotNull()
    rows = counts.withColumn("m", F.when(found, F.col("n")).otherwise(0))
    rows = rows.withColumns({"total": F.sum("m").over(own), "upto": F.sum("m").over(own.orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0))})

    def ranked(share: float):
        rank = F.least(F.col("total") - 1, F.floor(F.col("total").cast("float") * F.lit(share).cast("float")).cast("long"))
        return F.min(F.when(found & (F.col("upto") > rank), F.col("x")))

    return rows.groupBy("began", "kind").agg(
        F.sum("m").alias("samples"), (F.sum("n") - F.sum("m")).alias("errors"), *(ranked(p).alias(name) for name, p in SHARES.items()),
        F.max("x").alias("max"), (F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("mean"),
    )


def watched(times: DataFrame, at: str, columns: list[str], sink: Sink, width: str = "10 seconds", late: str = "1 minute", whole: bool = False, checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """sink(summaries, batch id) gets each window once it is closed: when results have come that are later by `late`.

    whole: it gets all windows so far with every batch instead, for runs that end.
    """
    writer = counted(times, at, columns, width, late).writeStream.outputMode("complete" if whole else "append").foreachBatch(lambda rows, n: sink(summaries(rows), n))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
