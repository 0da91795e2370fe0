"""From postings to impact segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions.scoring import LinearQuantizer, Scorer, norm_len_sql, saturated_sql, score
from loomrank.schema import BLOCK_BITS

CHUNK_BITS = 7
#: What keeps a posting's code in 32 bits with a sign.
POSTING = 1 << 31


def collection(docs: DataFrame) -> DataFrame:
    """One row: n (documents) and avg_len."""
    return docs.agg(F.count("*").alias("n"), (F.sum("doc_len") / F.count("*")).alias("avg_len"))


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def with_statistics(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Postings (term, doc_id, tf, doc_len) with df, n and norm_len; `stats` is one row (n, avg_len)."""
    rows = postings.join(frequencies(postings), "term").crossJoin(F.broadcast(stats))  # one row
    return rows.withColumn("norm_len", F.expr(norm_len_sql()))


def scored(postings: DataFrame, scorer: Scorer) -> DataFrame:
    return postings.withColumn("score", score(scorer))


def max_score(scored: DataFrame) -> DataFrame:
    return scored.agg(F.greatest(F.lit(0).cast("float"), F.max("score")).alias("max_score"))


@dataclass
class Impacts:
    """postings (term, doc_id, impact), the largest score as a row, and what is held until the segments are stored."""

    postings: DataFrame
    largest: DataFrame
    held: list[DataFrame]


def impacts(postings: DataFrame, stats: DataFrame, scorer: Scorer, bits: int = 8) -> Impacts:
    """Scored and quantised postings, or saturated frequencies without a pass for the maximum."""
    if not scorer.needs_quantization:
        one = postings.sparkSession.range(1).select(F.lit(1.0).cast("float").alias("max_score"))
        return Impacts(postings.select("term", "doc_id", F.expr(saturated_sql()).alias("impact")), one, [])
    # counted for df and scored, then scored for the maximum and quantised: each is made once and held, on disk where memory ends
    postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
    rows = scored(with_statistics(postings, stats), scorer).select("term", "doc_id", "score").persist(StorageLevel.MEMORY_AND_DISK)
    value = F.lit(max_score(rows).first()[0]).cast("float").alias("max_score")
    largest = postings.sparkSession.range(1).select(value)
    return Impacts(rows.select("term", "doc_id", "score", value).select("term", "doc_id", F.expr(LinearQuantizer(bits).sql()).alias("impact")), largest, [postings, rows])


def gathered(postings: DataFrame, stats: DataFrame, scorer: Scorer, partitions: int) -> DataFrame:
    """lists: a row per term and 65,536 ids (part), with their offsets, the scores or impacts of its postings, and the largest.

    This is the only step of building that shuffles postings, each once and by its term, so
    a term's frequency is known where its scores are needed.  Rows stay bounded.
    """
    half = 1 << (BLOCK_BITS - 1)
    n, average = stats.select("n", "avg_len").first()
    early = hasattr(scorer, "weight_sql")  # what doesn't depend on the term is computed before the shuffle
    value = {"impact": saturated_sql()} if not scorer.needs_quantization else {"weight": scorer.weight_sql()} if early else {"tf": "tf", "norm_len": "norm_len"}
    rows = postings.withColumn("avg_len", F.lit(average).cast("double")).withColumn("norm_len", F.expr(norm_len_sql()))
    offset = (F.col("doc_id").bitwiseAND((1 << BLOCK_BITS) - 1) - half).cast("short").alias("offset")
    keyed = rows.select("term", F.shiftright("doc_id", BLOCK_BITS).cast("int").alias("part"), offset, *(F.expr(x).alias(c) for c, x in value.items()))
    # lists of one aggregation get their values row by row, none of them null, so they stay in step; primitive ones take a fraction of structs
    rows = keyed.repartition(partitions, "term").groupBy("term", "part").agg(*(F.collect_list(c).alias(f"{c}s") for c in keyed.columns[2:]))
    if not scorer.needs_quantization:
        return rows.select("term", "part", "offsets", F.col("impacts").alias("scores")).withColumn("top", F.array_max("scores"))
    rows = rows.withColumn("df", F.sum(F.size("offsets").cast("long")).over(Window.partitionBy("term"))).withColumn("n", F.lit(n).cast("long"))
    if early:
        scores = F.expr("transform(weights, weight -> idf * weight)")
        rows = rows.withColumn("idf", F.expr(f"CAST({scorer.idf_sql()} AS FLOAT)"))
    else:
        scores = F.expr(f"zip_with(tfs, norm_lens, (tf, norm_len) -> {scorer.sql()})")
    return rows.select("term", "part", "offsets", scores.alias("scores")).withColumn("top", F.array_max("scores"))


def coded(lists: DataFrame, impact: str, bits: int = BLOCK_BITS) -> DataFrame:
    """lists with one ascending array of longs, codes: block within the part, impact (SQL of `score`) and place within the block, 16 bits each."""
    place = f"(CAST(o AS INT) + {1 << (BLOCK_BITS - 1)})"
    code = f"shiftleft(CAST(shiftright({place}, {bits}) AS BIGINT), 32) + shiftleft(CAST({impact} AS BIGINT), 16) + ({place} & {(1 << bits) - 1})"
    # both arrays are in step and have no nulls; said so, the codes are sorted as plain longs
    return lists.withColumn("codes", F.expr(f"sort_array(zip_with(offsets, scores, (o, score) -> coalesce({code}, 0L)))")).drop("offsets", "scores")


def _runs(coded: DataFrame, shift: int, value: str, name: str) -> DataFrame:
    """term, part and a struct for each run of codes that agree above `shift` bits: `value` may use codes, i (its first place, from 1) and m (how many)."""
    starts = coded.withColumn("starts", F.expr(f"filter(sequence(1, size(codes)), i -> i = 1 OR shiftright(codes[i - 1], {shift}) <> shiftright(codes[i - 2], {shift}))"))
    each = f"transform(transform(starts, (i, k) -> struct(i AS i, (CASE WHEN k + 1 < size(starts) THEN starts[k + 1] ELSE size(codes) + 1 END) - i AS m)), r -> {value})"
    return starts.select("term", "part", F.explode(F.expr(each)).alias(name))


def unpacked(coded: DataFrame, bits: int, kind) -> DataFrame:
    """The blocks (as packed() has them) of lists with codes of as many bits; no row leaves its task."""
    half = 1 << (BLOCK_BITS - 1)
    docs = f"transform(slice(codes, r.i, r.m), c -> CAST((c & 65535) - {half} AS SHORT))"
    rows = _runs(coded, 16, f"struct(shiftright(codes[r.i - 1], 16) AS code, {docs} AS docs)", "run")
    block = F.expr(f"CAST(shiftleft(part, {BLOCK_BITS - bits}) + shiftright(run.code, 16) AS INT)").alias("block")
    rows = rows.select("term", F.expr("CAST(run.code & 65535 AS INT)").alias("impact"), block, F.col("run.docs").alias("docs"))
    return rows.select("term", "impact", "block", (F.shiftleft(F.col("block").cast(kind), bits) + F.lit(half).cast(kind)).alias("base"), "docs")


def list_tops(coded: DataFrame, bits: int) -> DataFrame:
    """tops() of lists with codes of as many bits: a block's last code has its largest impact."""
    value = "struct(shiftright(codes[r.i - 1], 32) AS block, CAST(shiftright(codes[r.i + r.m - 2], 16) & 65535 AS INT) AS top, CAST(r.m AS BIGINT) AS count)"
    block = F.expr(f"CAST(shiftleft(part, {BLOCK_BITS - bits}) + run.block AS INT)").alias("block")
    return _runs(coded, 32, value, "run").select("term", block, "run.top", "run.count")


def list_levels(coded: DataFrame) -> DataFrame:
    """term, impact and count of each row of lists with codes of BLOCK_BITS bits; a segment has one in every part."""
    value = "struct(CAST(shiftright(codes[r.i - 1], 16) & 65535 AS INT) AS impact, CAST(r.m AS BIGINT) AS count)"
    return _runs(coded, 16, value, "run").select("term", "run.impact", "run.count")


def recoded(blocks: DataFrame, bits: int, inner: int = 0) -> DataFrame:
    """coded() of stored blocks of 2 ** bits ids, with codes of bits + inner bits."""
    wide = BLOCK_BITS - bits
    block, start = f"shiftright(block & {(1 << wide) - 1}, {inner})", f"shiftleft(block & {(1 << inner) - 1}, {bits})"
    code = f"shiftleft(CAST({block} AS BIGINT), 32) + shiftleft(CAST(impact AS BIGINT), 16) + ({start} + CAST(o AS INT) + {1 << (BLOCK_BITS - 1)})"
    rows = blocks.select("term", F.shiftright("block", wide).alias("part"), F.expr(f"transform(docs, o -> {code})").alias("codes"))
    return rows.groupBy("term", "part").agg(F.sort_array(F.flatten(F.collect_list("codes"))).alias("codes"))


def zoned(coded: DataFrame, bits: int, inner: int) -> DataFrame:
    """A row per term and zone of 2 ** inner blocks: codes (of a posting, POSTING less than impact * 65,536 + place in the zone, by blocks), tops (of a block, its number in the zone * 65,536 + largest impact) and the largest impact.

    coded: lists with codes of as many bits; bits + inner are at most BLOCK_BITS, and no row leaves its task.
    """
    code = f"CAST(shiftleft(shiftright(c, 16) & 65535, 16) + shiftleft(shiftright(c, 32) & {(1 << inner) - 1}, {bits}) + (c & 65535) - {POSTING} AS INT)"
    last = "filter(slice(codes, r.i, r.m), (c, n) -> n + 1 = r.m OR shiftright(c, 32) <> shiftright(codes[r.i + n], 32))"
    top = f"CAST(shiftleft(shiftright(c, 32) & {(1 << inner) - 1}, 16) + (shiftright(c, 16) & 65535) AS INT)"
    value = f"struct(shiftright(codes[r.i - 1], {32 + inner}) AS zone, transform(slice(codes, r.i, r.m), c -> {code}) AS codes, transform({last}, c -> {top}) AS tops)"
    zone = F.expr(f"CAST(shiftleft(part, {BLOCK_BITS - bits - inner}) + run.zone AS INT)").alias("zone")
    rows = _runs(coded, 32 + inner, value, "run").select("term", zone, "run.codes", "run.tops")
    return rows.withColumn("most", F.expr("array_max(transform(tops, t -> t & 65535))"))


def leveled(coded: DataFrame, bits: int) -> DataFrame:
    """A row per term and zone of 2 ** bits ids: codes (of a posting, POSTING less than impact * 65,536 + place in the zone, ascending), their count, and levels (of a run of one impact, POSTING less than impact * 65,536 + its place in codes, from 0).

    coded: lists with codes of as many bits; no row leaves its task.  Runs of one zone and
    impact are found once, and zones among them.
    """
    starts = "filter(sequence(1, size(codes)), i -> i = 1 OR shiftright(codes[i - 1], 16) <> shiftright(codes[i - 2], 16))"
    firsts = "filter(sequence(1, size(starts)), j -> j = 1 OR shiftright(codes[starts[j - 1] - 1], 32) <> shiftright(codes[starts[j - 2] - 1], 32))"
    runs = "transform(firsts, (j, n) -> struct(j AS j, (CASE WHEN n + 1 < size(firsts) THEN firsts[n + 1] ELSE size(starts) + 1 END) - j AS m))"
    zones = f"transform({runs}, r -> struct(r.j AS j, r.m AS m, starts[r.j - 1] AS i, (CASE WHEN r.j + r.m <= size(starts) THEN starts[r.j + r.m - 1] ELSE size(codes) + 1 END) - starts[r.j - 1] AS count))"
    level = f"CAST((codes[s - 1] & 4294901760) + s - r.i - {POSTING} AS INT)"
    value = f"struct(shiftright(codes[r.i - 1], 32) AS zone, r.count AS count, transform(slice(codes, r.i, r.count), c -> CAST((c & 4294967295) - {POSTING} AS INT)) AS codes, transform(slice(starts, r.j, r.m), s -> {level}) AS levels)"
    found = coded.withColumn("starts", F.expr(starts)).withColumn("firsts", F.expr(firsts)).select("term", "part", F.explode(F.expr(f"transform({zones}, r -> {value})")).alias("run"))
    zone = F.expr(f"CAST(shiftleft(part, {BLOCK_BITS - bits}) + run.zone AS INT)").alias("zone")
    return found.select("term", zone, "run.count", "run.codes", "run.levels")


def leveled_directory(leveled: DataFrame) -> DataFrame:
    """The directory of lists with levels."""
    value = f"struct(CAST(shiftright(l + {POSTING}, 16) AS INT) AS impact, (CASE WHEN n + 1 < size(levels) THEN levels[n + 1] & 65535 ELSE count END) - (l & 65535) AS m)"
    rows = leveled.select("term", F.explode(F.expr(f"transform(levels, (l, n) -> {value})")).alias("run"))
    return rows.groupBy("term", "run.impact").agg(F.sum(F.col("run.m").cast("long")).alias("count"))


def below(cut: str) -> str:
    """SQL: how many codes of lists with levels have an impact below a column's."""
    return f"coalesce(get(filter(levels, l -> l >= CAST({cut} AS BIGINT) * 65536 - {POSTING}), 0) & 65535, count)"


def blocks(impacts: DataFrame) -> DataFrame:
    """Ascending ids of every segment in ranges of 2 ** BLOCK_BITS ids."""
    keyed = impacts.select("term", "impact", F.shiftright("doc_id", BLOCK_BITS).alias("block"), "doc_id")
    return keyed.groupBy("term", "impact", "block").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


def packed(impacts: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """blocks with 16-bit offsets: docs counts from base, half-way into the block, so that any id of 32 bits takes two bytes.

    base has the ids' type, int or long, and so have the sums base + offset.
    """
    kind = impacts.schema["doc_id"].dataType
    half = 1 << (BLOCK_BITS - 1)
    keyed = impacts.select("term", "impact", F.shiftright("doc_id", bits).cast("int").alias("block"), (F.col("doc_id").bitwiseAND((1 << bits) - 1) - half).cast("short").alias("offset"))
    base = (F.shiftleft(F.col("block").cast(kind), bits) + F.lit(half).cast(kind)).alias("base")
    rows = keyed.groupBy("term", "impact", "block").agg(F.sort_array(F.collect_list("offset")).alias("docs"))
    return rows.select("term", "impact", "block", base, "docs")


def exploded(blocks: DataFrame, *columns: str) -> DataFrame:
    """The given columns and doc_id of every posting of the blocks, packed or not."""
    if "base" not in blocks.columns:
        return blocks.select(*columns, F.explode("docs").alias("doc_id"))
    return blocks.select(*columns, "base", F.explode("docs").alias("offset")).select(*columns, (F.col("base") + F.col("offset")).alias("doc_id"))


def absolute(blocks: DataFrame) -> DataFrame:
    """term, impact, block and docs, with whole ids in place of offsets."""
    if "base" not in blocks.columns:
        return blocks
    return blocks.select("term", "impact", "block", F.transform("docs", lambda x: F.col("base") + x).alias("docs"))


def tops(blocks: DataFrame) -> DataFrame:
    """What a term has in a block: its largest impact (top) and its postings (count)."""
    return blocks.groupBy("term", "block").agg(F.max("impact").alias("top"), F.sum(F.size("docs")).alias("count"))


def directory(blocks: DataFrame) -> DataFrame:
    """The postings of every segment (term, impact)."""
    return blocks.groupBy("term", "impact").agg(F.sum(F.size("docs")).alias("count"))


def joined(blocks: DataFrame) -> DataFrame:
    """Whole segments again, for looking at small ones: term, impact, count, docs."""
    parts = absolute(blocks).groupBy("term", "impact").agg(F.sort_array(F.collect_list(F.struct("block", "docs"))).alias("parts"))
    return parts.select("term", "impact", F.flatten("parts.docs").alias("docs")).withColumn("count", F.size("docs").cast("long"))


def summary(directory: DataFrame) -> DataFrame:
    """num_postings, num_levels and max_level."""
    return directory.agg(F.sum("count").alias("num_postings"), F.countDistinct("impact").alias("num_levels"), F.max("impact").alias("max_level"))


def checked_dense(docs: DataFrame) -> DataFrame:
    """Raises where ids aren't 0 to n - 1: ids are positions."""
    n, top, least = docs.agg(F.countDistinct("doc_id"), F.max("doc_id"), F.min("doc_id")).first()
    if n and (least != 0 or n != top + 1):
        raise ValueError(f"document ids must be dense: {n} ids from {least} to {top}")
    return docs


def ordered(directory: DataFrame) -> DataFrame:
    return directory.orderBy("term", F.desc("impact"))
