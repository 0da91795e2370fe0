"""Lines of run files and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trec(results: DataFrame, tag: str = "loomrank") -> DataFrame:
    """`qid Q0 ext_id rank score tag`."""
    return results.select("qid", "rank", F.format_string("%d Q0 %s %d %d %s", "qid", "ext_id", "rank", "score", F.lit(tag)).alias("value"))


def tsv(results: DataFrame) -> DataFrame:
    """`qid ext_id rank`, separated by spaces."""
    return results.select("qid", "rank", F.concat_ws(" ", F.col("qid").cast("string"), "ext_id", F.col("rank").cast("string")).alias("value"))


def _ranked(results: DataFrame, fields: Column) -> DataFrame:
    """At most k rows of a query meet here."""
    return results.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", fields.alias("item")))).alias("rows")).select("qid", F.col("rows.item").alias("items"))


def display(results: DataFrame, took_ms: int = 0) -> DataFrame:
    """A line per query with internal ids."""
    item = F.format_string("#%d,(%d,%d)", "rank", "doc_id", "score")
    return _ranked(results, item).select("qid", F.format_string("query %d took: %dms [%s]", "qid", F.lit(took_ms), F.array_join("items", ",")).alias("value"))


def json(results: DataFrame, took_micros: int = 0) -> DataFrame:
    """A response per query: the best documents (internal ids), the time, and the query id 0 that servers give."""
    took = F.struct(F.lit(took_micros // 1_000_000).alias("secs"), F.lit(took_micros % 1_000_000 * 1000).alias("nanos"))
    rows = _ranked(results, F.struct("doc_id", "score"))
    return rows.select("qid", F.to_json(F.struct(F.col("items").alias("topk"), took.alias("took"), F.lit(0).alias("qid"))).alias("value"))


def write(lines: DataFrame, path: str) -> None:
    """A text file per task, in the order of query and rank."""
    order = [c for c in ("qid", "rank") if c in lines.columns]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
