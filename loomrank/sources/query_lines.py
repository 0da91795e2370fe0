"""Query files: one query per line, `<id>:<tokens>`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions.scoring import rescaled_sql
from loomrank.functions.text import tokens

#: Largest weight of a token, with and without weights.
WEIGHTED, UNWEIGHTED = 32, 1


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """qid, tokens of every valid line: split at the first colon, an unsigned id before it, tokens behind it.

    Lines without a colon, with another id or without tokens are dropped.
    """
    head, tail = F.regexp_extract(column, r"(?s)^([^:]*):(.*)$", 1), F.regexp_extract(column, r"(?s)^([^:]*):(.*)$", 2)
    rows = lines.where(F.col(column).contains(":")).select(head.alias("id"), tokens(tail, unicode=True).alias("tokens"))
    rows = rows.where(F.col("id").rlike(r"^\+?[0-9]+$") & (F.size("tokens") > 0))
    return rows.select(F.expr("try_cast(id AS BIGINT)").alias("qid"), "tokens").where("qid IS NOT NULL")


def bags(queries: DataFrame) -> DataFrame:
    """qid, token, freq, max_freq and pos; tokens are ordered descending by bytes."""
    counts = queries.select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count("*").alias("freq"))
    own = Window.partitionBy("qid")
    return counts.select(
        "qid", "token", "freq", F.max("freq").over(own).alias("max_freq"), (F.row_number().over(own.orderBy(F.desc("token"))) - 1).alias("pos")
    )


def rescaled(bag: DataFrame, weighted: bool = False) -> DataFrame:
    """query_terms: qid, pos, token and weight."""
    weight = F.expr(rescaled_sql("freq", "max_freq", WEIGHTED if weighted else UNWEIGHTED))
    return bag.select("qid", "pos", "token", weight.alias("weight"))


def from_lines(lines: DataFrame, weighted: bool = False, column: str = "value") -> DataFrame:
    return rescaled(bags(parsed(lines, column)), weighted)


def read(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return from_lines(spark.read.text(path), weighted)


def cycled(query_ids: DataFrame, n: int) -> DataFrame:
    """nth, qid: the queries in the order of their ids, again and again until n are taken."""
    count = query_ids.count()
    if not count:
        return query_ids.sparkSession.createDataFrame([], "nth long, qid long")
    placed = query_ids.select("qid", (F.row_number().over(Window.orderBy("qid")) - 1).alias("place"))  # queries, not data
    return query_ids.sparkSession.range(n).select(F.col("id").alias("nth"), (F.col("id") % count).cast("int").alias("place")).join(placed, "place").select("nth", "qid")


def unique_tokens(query_terms: DataFrame) -> DataFrame:
    return query_terms.select("token").distinct()
