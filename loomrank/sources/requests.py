"""Search requests in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.schema import REQUEST


def parsed(rows: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """request (the row's number within the batch), qid, tokens, k, rho, budget, error for what can't be served, and the columns to keep.

    Tokens keep their given order and may repeat; weights aren't rescaled.
    """
    r = F.from_json(column, REQUEST)
    out = rows.select(F.monotonically_increasing_id().alias("request"), F.col(column).alias("body"), r.alias("r"), *(keep or [])).select(
        "request", "body", *(keep or []), F.col("r.query.id").alias("qid"), F.col("r.query.tokens").alias("tokens"), F.col("r.k").alias("k"), F.col("r.query_mode.Fraction").alias("rho"), F.col("r.query_mode.Fixed").alias("budget")
    )
    error = (
        F.when(F.col("qid").isNull() | F.col("tokens").isNull(), "no query")
        .when(F.col("k").isNull() | (F.col("k") < 1), "k must be at least 1")
        .when(F.col("rho").isNull() == F.col("budget").isNull(), "one of Fraction and Fixed is needed")
        .when((F.col("rho") < 0) | (F.col("rho") > 1), "Fraction must be from 0 to 1")
        .when(F.exists("tokens", lambda t: (t["freq"] < 0) | (t["freq"] > 65535) | t["token"].isNull()), "weights must be from 0 to 65535")
    )
    return out.withColumn("error", error)


def query_terms(requests: DataFrame) -> DataFrame:
    """query_terms of valid requests; their qid is the request's number."""
    return requests.where("error IS NULL").select(F.col("request").alias("qid"), F.posexplode("tokens").alias("pos", "t")).select("qid", "pos", F.col("t.token").alias("token"), F.col("t.freq").cast("int").alias("weight"))


def error_bodies(requests: DataFrame) -> DataFrame:
    return requests.where("error IS NOT NULL").select("body", F.to_json(F.struct("error")).alias("response"))
