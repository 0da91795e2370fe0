"""Sizes of encoded document-id lists: bit-packed blocks of gaps, byte-packed tails, or plain integers.

The lists themselves are stored as Parquet arrays.  These expressions say what a
list would take in the classic encodings, from the gaps between ascending ids.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_LEN = 128


def gaps(ids: Column, before: Column) -> Column:
    """Differences of ascending ids; the first one's from `before`."""
    return F.transform(ids, lambda x, i: x.cast("long") - F.when(i == 0, before.cast("long")).otherwise(F.element_at(ids, F.greatest(i, F.lit(1)))))


def _sums(values: Column, before: Column) -> Column:
    """Running sums; each step copies the ones before it, so this is for short arrays."""
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), before.cast("long").alias("last"))
    return F.aggregate(values, start, lambda acc, g: F.struct(F.concat(acc["ids"], F.array(acc["last"] + g)).alias("ids"), (acc["last"] + g).alias("last")), lambda acc: acc["ids"])


def restored(differences: Column, before: Column) -> Column:
    """The ids whose gaps these are; long lists go by runs of BLOCK_LEN, so that the work grows with the list and not with its square."""
    nths = F.sequence(F.lit(0), ((F.size(differences) - 1) / BLOCK_LEN).cast("int"))
    parts = F.transform(nths, lambda k: _sums(F.slice(differences, k * BLOCK_LEN + 1, BLOCK_LEN), F.lit(0)))
    ends = _sums(F.transform(parts, lambda x: F.element_at(x, -1)), before)
    long = F.flatten(F.zip_with(parts, ends, lambda part, end: F.transform(part, lambda x: x + (end - F.element_at(part, -1)))))
    return F.when(F.size(differences) > BLOCK_LEN, long).otherwise(_sums(differences, before))


def bit_width_sql(gap: str) -> str:
    return f"CASE WHEN {gap} = 0 THEN 0 ELSE LENGTH(BIN({gap})) END"


def full_block_sql(widest: str) -> str:
    """A full block: one byte for the width, then every gap in that many bits."""
    return f"1 + {BLOCK_LEN // 8} * {widest}"


def tail_sql(count: str, data_bytes: str) -> str:
    """A last, shorter block: two bits of length for each gap, then its bytes."""
    return f"CAST(CEIL({count} / CAST(4 AS DOUBLE)) AS BIGINT) + {data_bytes}"


def byte_width_sql(gap: str) -> str:
    return f"GREATEST(1, CAST(CEIL(({bit_width_sql(gap)}) / CAST(8 AS DOUBLE)) AS BIGINT))"


def plain_sql(count: str) -> str:
    return f"4 * {count}"
