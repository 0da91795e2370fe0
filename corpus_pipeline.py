"""From raw documents to packed training sequences, in stages that are written and read again.

Toxic documents go, one document of each group of near-duplicates stays, repeated
passages are cut out, and what is left is tokenised and packed.  Every stage gets
all that its predecessor kept.  The last one returns a row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomrank.llm import near_dedup, packing, scratch, suffix_dedup, toxicity
from loomrank.llm.queries import table, tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stages called so far in this session.
_earlier: list[str] = []


def _stage(f: Stage) -> Stage:
    """A stage's result is written before the next one is called, so the scratch tables of earlier stages can go."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.sweep(spark, _earlier)
        _earlier.clear()
        start = scratch.mark()
        out = f(spark, docs, sf_dir)
        _earlier.extend(scratch.since(start))
        return out

    return run


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; labels teach the model and decide nothing.  Null and empty texts are scored without evidence."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), threshold=0.3)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of similar documents."""
    return near_dedup.kept(docs, percent=75)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that occur twice; n_chars follows."""
    return suffix_dedup.cleaned(docs, length=200)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence of 1024 tokens; a null or empty text is its end id alone."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", sequences),
]

#: Scores, MinHash groups, repeated strings and packing have no SQL form; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
