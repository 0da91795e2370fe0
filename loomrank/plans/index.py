"""Building, storing and opening an index.

A stored index is a folder of bucketed tables and a manifest.  blocks are bucketed by
term and block, so a term that a third of all documents have is spread by ranges of
ids; tops and directory are bucketed by term.  Searches join them by just these
columns, so only the batch's side is shuffled, whatever its size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from loomrank import storage
from loomrank.functions.scoring import BM25, LinearQuantizer, Scorer
from loomrank.operators import segments
from loomrank.schema import BLOCK_BITS
from loomrank.sources import ciff, text

TABLES = ("docs", "directory", "tops", "blocks", "stats")
#: Columns that a table is bucketed by, and what its buckets are sorted by.
BUCKETS = {"lists": (["term"], []), "zones": (["qid", "zone"], []), "bounds": (["qid", "zone"], []), "scores": (["qid", "zone"], []), "directory": (["term"], ["term", "impact"]), "tops": (["term"], ["term", "block"]), "blocks": (["term", "block"], ["term", "block", "impact"])}
#: Postings of a bucket, about: two bytes each.
BUCKET = 1 << 25
#: Tokens of a partition of lists, about.
LIST = 1 << 21
STATS = ("num_docs", "avg_len", "max_score", "quant_bits", "num_postings", "num_levels", "max_level", "max_doc_id")


@dataclass
class Lists:
    """Rows of segments.gathered(), the impact of a score as SQL, and the views that an index has of them."""

    rows: DataFrame
    impact: str
    block_bits: int
    kind: DataType

    def views(self) -> dict[str, DataFrame]:
        fine = segments.coded(self.rows, self.impact, self.block_bits)
        directory = segments.list_levels(segments.coded(self.rows, self.impact)).groupBy("term", "impact").agg(F.sum("count").alias("count"))
        return {"blocks": segments.unpacked(fine, self.block_bits, self.kind), "tops": segments.list_tops(fine, self.block_bits), "directory": directory}

    def summary(self) -> DataFrame:
        """segments.summary() without going by terms."""
        levels = segments.list_levels(segments.coded(self.rows, self.impact)).groupBy("impact").agg(F.sum("count").alias("count"))
        return levels.agg(F.sum("count").alias("num_postings"), F.count("impact").alias("num_levels"), F.max("impact").alias("max_level"))


@dataclass
class Index:
    """docs, directory (term, impact, count), tops (term, block, top, count), blocks (term, impact, block, base, docs) and one row of stats."""

    docs: DataFrame
    directory: DataFrame
    tops: DataFrame
    blocks: DataFrame
    stats: DataFrame
    average: DataFrame
    largest: DataFrame
    bits: int
    block_bits: int = BLOCK_BITS
    stored: bool = False  # read from files
    lists: Lists | None = None  # what building wrote, which blocks, tops and directory are views of

    def persist(self) -> Index:
        """Holds the documents and the row of stats; postings lie in the files of lists, which searches read by their terms."""
        for name in ("docs", "stats"):
            getattr(self, name).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for name in ("docs", "stats"):
            getattr(self, name).unpersist()

    def of(self, query_terms: DataFrame) -> Index:
        """The index of a batch's tokens alone: a stored one as it is, else views of their lists."""
        if self.lists is None:
            return self
        wanted = query_terms.select(F.col("token").alias("term")).distinct()
        rows = self.lists.rows.join(wanted, "term", "left_semi")
        own = replace(self.lists, rows=rows)
        return replace(self, lists=own, **own.views())

    def zones(self, query_terms: DataFrame, inner: int) -> DataFrame:
        """segments.zoned() of a batch's tokens alone, in zones of 2 ** inner blocks."""
        wanted = query_terms.select(F.col("token").alias("term")).distinct()
        if self.lists is None:
            coded = segments.recoded(self.blocks.join(wanted, "term", "left_semi"), self.block_bits)
        else:
            coded = segments.coded(self.lists.rows.join(wanted, "term", "left_semi"), self.lists.impact, self.block_bits)
        return segments.zoned(coded, self.block_bits, inner)

    def leveled(self, query_terms: DataFrame, inner: int) -> DataFrame:
        """segments.leveled() of a batch's tokens alone, in zones of 2 ** inner blocks."""
        wanted = query_terms.select(F.col("token").alias("term")).distinct()
        if self.lists is None:
            coded = segments.recoded(self.blocks.join(wanted, "term", "left_semi"), self.block_bits, inner)
        else:
            coded = segments.coded(self.lists.rows.join(wanted, "term", "left_semi"), self.lists.impact, self.block_bits + inner)
        return segments.leveled(coded, self.block_bits + inner)

    @property
    def terms(self) -> DataFrame:
        """A row of every term at least: term."""
        return (self.directory if self.lists is None else self.lists.rows).select("term")

    def segment_list(self, term: str) -> DataFrame:
        """A term's segments, highest impact first."""
        return self.directory.where(F.col("term") == term).orderBy(F.desc("impact"))

    def getter(self, name: str):
        """num_docs, num_postings, num_levels, max_level, max_doc_id, avg_len, max_score or quant_bits."""
        return self.stats.select(name).first()[0]

    @property
    def num_docs(self) -> int:
        return self.getter("num_docs") if self.lists is None else self.docs.count()  # the row of stats goes through every list


def _stats(docs: DataFrame, average: DataFrame, largest: DataFrame, summary: DataFrame, bits: int) -> DataFrame:
    facts = docs.agg(F.count("*").alias("num_docs"), F.max("doc_id").alias("max_doc_id"))
    row = facts.crossJoin(average).crossJoin(largest).crossJoin(summary)  # one row each
    return row.withColumn("quant_bits", F.lit(bits).cast("int")).select(*STATS)


def _derived(docs: DataFrame, average: DataFrame, largest: DataFrame, blocks: DataFrame, bits: int, block_bits: int) -> Index:
    """The other tables follow from the blocks."""
    directory = segments.directory(blocks)
    stats = _stats(docs, average, largest, segments.summary(directory), bits)
    return Index(docs, directory, segments.tops(blocks), blocks, stats, average, largest, bits, block_bits)


def _built(postings: DataFrame, docs: DataFrame, stats: DataFrame, scorer: Scorer, bits: int, block_bits: int) -> Index:
    """Postings are gathered and scored by term and written, bucketed by it; the tables are views of that."""
    if not 1 <= block_bits <= BLOCK_BITS:
        raise ValueError(f"blocks have from 1 to {BLOCK_BITS} bits")
    spark, path, docs = docs.sparkSession, storage.new_dir(docs.sparkSession, "lists"), docs.select("doc_id", "ext_id", "doc_len")
    stats = storage.saved(stats, "collection")
    n, average = stats.select("n", "avg_len").first()
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-int(n * (average or 0)) // LIST))
    lists = segments.gathered(postings, stats, scorer, buckets)
    _bucketed(lists, path, "lists", buckets, {}, dealt=True)
    rows = _opened(spark, path, "lists", _ddl(lists), buckets)
    one, impact = F.lit(1.0), "score"
    if scorer.needs_quantization:
        top = rows.agg(F.greatest(F.lit(0).cast("float"), F.max("top"))).first()[0]
        one, impact = F.lit(top), LinearQuantizer(bits).sql("score", f"CAST({top!r} AS FLOAT)")
    own = Lists(rows, impact, block_bits, postings.schema["doc_id"].dataType)
    largest, average = spark.range(1).select(one.cast("float").alias("max_score")), stats.select("avg_len")
    views = own.views()
    return Index(docs, views["directory"], views["tops"], views["blocks"], _stats(docs, average, largest, own.summary(), bits), average, largest, bits, block_bits, lists=own)


def from_documents(
    documents: DataFrame, scorer: Scorer | None = None, bits: int = 8, id_column: str = "doc_id", text_column: str = "text", dense: bool = True, block_bits: int = BLOCK_BITS, wide: bool = False,
) -> Index:
    """An index of raw text; ids must be dense from 0 unless `dense` is off.

    wide: ids up to 2**32 - 1, as long; else they are int.  block_bits: a block is a
    range of that many bits of ids, at most 16; smaller ones let searches skip more
    and take more rows.
    """
    docs = storage.saved(text.lengths(documents, id_column, text_column, wide), "docs")  # every text is split once for it
    if dense:
        segments.checked_dense(docs)
    return _built(text.counted(documents, id_column, text_column, wide), docs, segments.collection(docs), scorer or BM25(), bits, block_bits)


def from_ciff(spark: SparkSession, path: str, scorer: Scorer | None = None, bits: int = 8, block_bits: int = BLOCK_BITS, wide: bool = False, dense: bool = True) -> Index:
    """An index of a CIFF file, or of a folder of them; the average length is the header's, or what several headers give.

    wide: the file's 32-bit ids are unsigned.
    """
    ciff.positioned(spark, path)
    docs = ciff.docs(ciff.read(spark, path, "docs"), wide)
    if dense:
        segments.checked_dense(docs)
    postings = ciff.postings(ciff.read(spark, path, "postings"), wide, ciff.single_lists(path)).join(docs.select("doc_id", "doc_len"), "doc_id")
    overall = F.sum("total_terms_in_collection") / F.sum("num_docs")
    average = ciff.read(spark, path, "header").agg(F.when(F.count("*") > 1, overall).otherwise(F.first("average_doclength")).alias("avg_len"))
    stats = docs.agg(F.count("*").alias("n")).crossJoin(average)
    return _built(postings, docs, stats, scorer or BM25(), bits, block_bits)


def _name(path: str, table: str) -> str:
    return f"loomrank_{hashlib.sha256(path.encode()).hexdigest()[:24]}_{table}"


def _bucketed(df: DataFrame, path: str, table: str, buckets: int, options: dict[str, str], dealt: bool = False) -> None:
    """A bucketed table at a path: a file a bucket.  The catalogue's entry goes again, the files stay.  dealt: the rows lie by buckets already."""
    spark, (keys, order) = df.sparkSession, BUCKETS[table]
    name = _name(path, f"{table}_new")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = (df if dealt else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys)
    (writer.sortBy(*order) if order else writer).options(**options).option("path", f"{path}/{table}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def _opened(spark: SparkSession, path: str, table: str, schema: str, buckets: int) -> DataFrame:
    """A bucketed table under a name of its own in the session's catalogue, which has to say what the buckets are."""
    keys, order = BUCKETS[table]
    name = _name(path, table)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}){f" SORTED BY ({', '.join(order)})" if order else ''} INTO {buckets} BUCKETS LOCATION '{path}/{table}'")
    return spark.table(name)


def dealt(df: DataFrame, table: str, buckets: int, lying: bool = False) -> DataFrame:
    """Written in buckets and read again: what follows by the buckets' columns shuffles nothing; lying: rows come from as many buckets of these columns and stay there."""
    path = storage.new_dir(df.sparkSession, table)
    _bucketed(df, path, table, buckets, {}, dealt=lying)
    return _opened(df.sparkSession, path, table, _ddl(df), buckets)


def write(index: Index, path: str, buckets: int | None = None, codecs: dict[str, str] | None = None) -> None:
    """The index's tables in a new folder, and last its manifest; a folder that has files is refused.

    codecs: the Parquet codec of a table ("blocks", "tops", "directory", "docs"), such as zstd or uncompressed; stored_bytes() tells what they take.
    """
    wrong = set(codecs or ()) - set(TABLES)
    if wrong:
        raise ValueError(f"no such tables: {', '.join(sorted(wrong))}")
    options = {t: {"compression": c} for t, c in (codecs or {}).items()}
    spark = index.docs.sparkSession
    index.docs.write.options(**options.get("docs", {})).parquet(f"{path}/docs")
    tokens = spark.read.parquet(f"{path}/docs").agg(F.sum("doc_len")).first()[0] or 0  # at least as many as postings
    n = buckets or max(8, -(-tokens // BUCKET))
    _bucketed(index.blocks, path, "blocks", n, options.get("blocks", {}))
    blocks = _opened(spark, path, "blocks", _ddl(index.blocks), n)
    rest = _derived(spark.read.parquet(f"{path}/docs"), index.average, index.largest, blocks, index.bits, index.block_bits)  # scored once: all else comes from what is stored
    _bucketed(rest.directory, path, "directory", n, options.get("directory", {}))
    _bucketed(rest.tops, path, "tops", n, options.get("tops", {}))
    rest.stats.write.parquet(f"{path}/stats")
    facts = {"buckets": n, "block_bits": index.block_bits, "schemas": {t: _ddl(getattr(rest, t)) for t in ("directory", "tops", "blocks")}}
    storage.commit(spark, path, list(TABLES), facts)


def stored_bytes(spark: SparkSession, path: str) -> dict[str, int]:
    """What each table's files take, as the manifest has it."""
    return storage.lengths(spark, path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def read(spark: SparkSession, path: str) -> Index:
    """A stored index; one whose files aren't those of its manifest is refused."""
    facts = storage.committed(spark, path)
    docs, stats = (spark.read.parquet(f"{path}/{name}") for name in ("docs", "stats"))
    directory, tops, blocks = (_opened(spark, path, t, facts["schemas"][t], facts["buckets"]) for t in ("directory", "tops", "blocks"))
    return Index(docs, directory, tops, blocks, stats, stats.select("avg_len"), stats.select("max_score"), stats.select("quant_bits").first()[0], facts["block_bits"], stored=True)
