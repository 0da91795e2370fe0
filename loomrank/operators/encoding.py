"""Sizes of encoded segments, from their blocks of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions import codec
from loomrank.operators import segments


def with_gaps(blocks: DataFrame) -> DataFrame:
    """term, impact, block, start (postings of the segment before the block) and gaps; the first gap counts from the block before."""
    own = Window.partitionBy("term", "impact").orderBy("block")
    rows = segments.absolute(blocks).select(
        "term", "impact", "block", "docs",
        F.coalesce(F.lag(F.element_at("docs", -1)).over(own), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.size("docs")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    return rows.select("term", "impact", "block", "before", "start", codec.gaps(F.col("docs"), F.col("before")).alias("gaps"))


def restored(gaps: DataFrame) -> DataFrame:
    return gaps.select("term", "impact", "block", codec.restored(F.col("gaps"), F.col("before")).cast("array<int>").alias("docs"))


def block_sizes(gaps: DataFrame) -> DataFrame:
    """term, impact, part (of 128 postings), count, widest gap's bits, and bytes when packed and when plain."""
    rows = gaps.select("term", "impact", "start", F.posexplode("gaps").alias("i", "gap")).select("term", "impact", ((F.col("start") + F.col("i")) / codec.BLOCK_LEN).cast("long").alias("part"), "gap")
    rows = rows.select("term", "impact", "part", F.expr(codec.bit_width_sql("gap")).alias("bits"), F.expr(codec.byte_width_sql("gap")).alias("width"))
    parts = rows.groupBy("term", "impact", "part").agg(F.count("*").alias("count"), F.max("bits").alias("bits"), F.sum("width").alias("data"))
    packed = F.when(F.col("count") == codec.BLOCK_LEN, F.expr(codec.full_block_sql("bits"))).otherwise(F.expr(codec.tail_sql("count", "data")))
    return parts.select("term", "impact", "part", "count", "bits", packed.cast("long").alias("bytes"), F.expr(codec.plain_sql("count")).alias("plain_bytes"))


def segment_sizes(gaps: DataFrame) -> DataFrame:
    return block_sizes(gaps).groupBy("term", "impact").agg(F.sum("count").alias("count"), F.sum("bytes").alias("bytes"), F.sum("plain_bytes").alias("plain_bytes"))
