"""Postings of raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.text import tokens


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than cores, such as one small file, is dealt to all of them; larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: One more than the largest id, unsigned.
IDS = 1 << 32


def _id(column: str, wide: bool) -> Column:
    """The id as int; wide: as long, and refused beyond 32 bits."""
    if not wide:
        return F.col(column).cast("int").alias("doc_id")
    x = F.col(column).cast("long")
    return F.when(x.between(0, IDS - 1), x).otherwise(F.raise_error(F.concat(F.lit("not an id of 32 bits: "), x.cast("string")))).alias("doc_id")


def lengths(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", wide: bool = False) -> DataFrame:
    """docs: doc_id, ext_id and doc_len (tokens) of every document; a null text has none."""
    n = F.size(tokens(F.coalesce(text_column, F.lit(""))))
    return documents.select(_id(id_column, wide), F.col(id_column).cast("string").alias("ext_id"), n.cast("int").alias("doc_len"))


def _unique(documents: DataFrame, id_column: str) -> bool:
    """Whether no id occurs twice; reads the ids alone."""
    return documents.groupBy(id_column).count().where("count > 1").isEmpty()


def counted(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", wide: bool = False) -> DataFrame:
    """postings with their document's length, so that scoring needs no join with docs: term, doc_id, tf, doc_len.

    A document's tokens lie in its own row, so they are sorted and counted there as runs of
    equal ones, and nothing is shuffled.  Only where ids repeat do rows have to meet.
    """
    words = documents.select(_id(id_column, wide), tokens(text_column).alias("tokens"))
    # a plain explode would add a filter that splits every text once more
    if not _unique(documents, id_column):
        terms = words.select("doc_id", F.size("tokens").alias("doc_len"), F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")
        return terms.groupBy("term", "doc_id", "doc_len").agg(F.count("*").cast("int").alias("tf"))
    ordered = words.select("doc_id", F.size("tokens").alias("doc_len"), F.sort_array("tokens").alias("tokens"))
    starts = "CASE WHEN doc_len > 0 THEN filter(sequence(1, doc_len), i -> i = 1 OR tokens[i - 1] <> tokens[i - 2]) END"
    runs = "transform(starts, (i, k) -> struct(tokens[i - 1] AS term, (CASE WHEN k + 1 < size(starts) THEN starts[k + 1] ELSE doc_len + 1 END) - i AS tf))"
    found = ordered.withColumn("starts", F.expr(starts)).select("doc_id", "doc_len", F.explode_outer(F.expr(runs)).alias("run"))
    return found.where("run IS NOT NULL").select("run.term", "doc_id", "doc_len", "run.tf")


def postings(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return counted(documents, id_column, text_column).select("term", "doc_id", "tf")
