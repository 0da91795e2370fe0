"""The queries that the driver runs, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions import codec, scoring
from loomrank.functions.scoring import BM25, Identity, LinearQuantizer
from loomrank.operators import encoding, latency, planning, ranking, segments
from loomrank.operators.planning import EXHAUSTIVE, Mode
from loomrank.plans import index as indexes
from loomrank.plans import rounds
from loomrank.plans import search as searches
from loomrank.plans.index import Index
from loomrank.schema import BLOCK_BITS, RESULTS
from loomrank.sinks import ciff as ciff_sink
from loomrank.sinks import runs
from loomrank.sources import ciff, query_lines, requests, text
from loomrank.storage import new_dir
from loomrank.streaming import latency as stream_latency
from loomrank.streaming import serve

K = 10
THRESHOLD = 20
#: Bits of ids in a block where searches are to skip blocks.
FINE = 4
#: Query lines out of conversations, in the words of both engines: ids with and without sign, bad and missing ones, no tokens, tokens that repeat beyond the largest weight.
LINE = """CASE turn % 6 WHEN 0 THEN CAST(100 * conv_id + turn AS STRING) || ':' || text WHEN 1 THEN '+' || CAST(100 * conv_id + turn AS STRING) || ':' || repeat(text || ' ', 40) || ' once'
    WHEN 2 THEN text WHEN 3 THEN '-' || CAST(100 * conv_id + turn AS STRING) || ':' || text WHEN 4 THEN CAST(100 * conv_id + turn AS STRING) || ':  ' ELSE 'x' || CAST(100 * conv_id + turn AS STRING) || ':' || text END"""
#: What a request for a benchmark query asks for: some ask for no results, some for more than all postings.
ASKED = {
    "k": "CAST(CASE WHEN qid % 4 = 3 THEN 0 ELSE 1 + qid % 5 END AS INT)",
    "rho": "CASE WHEN qid % 7 = 6 THEN CAST(1.5 AS DOUBLE) WHEN qid % 3 = 0 THEN CAST(1.0 AS DOUBLE) WHEN qid % 3 = 2 THEN CAST(0.5 AS DOUBLE) END",
    "fixed": "CASE WHEN qid % 7 <> 6 AND qid % 3 = 1 THEN CAST(100 * qid AS BIGINT) END",
}

_indexes: dict[tuple, Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, scorer=None, block_bits: int = BLOCK_BITS) -> Index:
    """The documents' index, built once per session and held: searches run on an index that is there."""
    key = (spark.sparkContext.applicationId, sf_dir, scorer or BM25(), block_bits)
    if key not in _indexes:
        _indexes[key] = indexes.from_documents(text.spread(table(spark, sf_dir, "documents")), scorer or BM25(), dense=False, block_bits=block_bits).persist()
    return _indexes[key]


def query_lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat_ws(":", F.col("item_id").cast("string"), "text").alias("value"))


def terms(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    return query_lines.from_lines(query_lines_of(spark, sf_dir), weighted)


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.expr(LINE).alias("value"))


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON request for every benchmark query, each sent twice."""
    tokens = F.array_sort(F.collect_list(F.struct("pos", "token", "weight")))
    own = terms(spark, sf_dir, True).groupBy("qid").agg(F.transform(tokens, lambda t: F.struct(t["token"].alias("token"), t["weight"].alias("freq"))).alias("tokens"))
    asked = own.select("qid", "tokens", *(F.expr(x).alias(name) for name, x in ASKED.items()))
    body = F.struct(F.struct(F.col("qid").alias("id"), "tokens").alias("query"), "k", F.struct(F.col("rho").alias("Fraction"), F.col("fixed").alias("Fixed")).alias("query_mode"))
    return asked.select(F.explode(F.array_repeat(F.to_json(body), 2)).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([("1:the la de",)], "value string")
    built = indexes.from_documents(table(spark, sf_dir, "documents"))
    return searches.search(built, query_lines.from_lines(lines), K)


# ---- DuckDB's side --------------------------------------------------------------------------------------------------

_SPACE = r"[ \t\n\x0B\f\r]+"
_BITS = 8


def _queries_cte(source: str, weighted: bool) -> dict[str, str]:
    limit = query_lines.WEIGHTED if weighted else query_lines.UNWEIGHTED
    return {
        "ql": source,
        "qp": r"SELECT TRY_CAST(regexp_extract(line, '^([^:]*):', 1) AS BIGINT) AS qid, unnest(regexp_split_to_array(regexp_extract(line, '(?s)^[^:]*:(.*)$', 1), '[ \t\n\x0B\f\r]+')) AS token "
        r"FROM ql WHERE regexp_matches(line, '^\+?[0-9]+:')",
        "qb": "SELECT qid, token, count(*) AS freq FROM qp WHERE token <> '' AND qid IS NOT NULL GROUP BY qid, token",
        "qm": "SELECT qid, token, freq, max(freq) OVER (PARTITION BY qid) AS max_freq, CAST(row_number() OVER (PARTITION BY qid ORDER BY token DESC) - 1 AS INTEGER) AS pos FROM qb",
        "qt": f"SELECT qid, pos, token, {scoring.rescaled_sql('freq', 'max_freq', limit)} AS weight FROM qm",
    }


_BENCHMARK = "SELECT CAST(item_id AS VARCHAR) || ':' || text AS line FROM benchmark"
_LINES = f"SELECT {LINE} AS line FROM conversations"

_CTE = {
    "tok": f"SELECT doc_id, unnest(regexp_split_to_array(text, '{_SPACE}')) AS term FROM documents",
    "post": "SELECT term, CAST(doc_id AS INTEGER) AS doc_id, CAST(count(*) AS INTEGER) AS tf FROM tok WHERE term <> '' GROUP BY term, doc_id",
    "dl": "SELECT CAST(d.doc_id AS INTEGER) AS doc_id, CAST(d.doc_id AS VARCHAR) AS ext_id, CAST(coalesce(p.n, 0) AS INTEGER) AS doc_len FROM documents d "
    "LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM post GROUP BY doc_id) p ON p.doc_id = d.doc_id",
    "cs": "SELECT count(*) AS n, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avg_len FROM dl",
    "tdf": "SELECT term, count(*) AS df FROM post GROUP BY term",
    "base": f"SELECT p.term, p.doc_id, p.tf, t.df, c.n, {scoring.norm_len_sql('d.doc_len', 'c.avg_len')} AS norm_len FROM post p JOIN tdf t ON t.term = p.term JOIN dl d ON d.doc_id = p.doc_id, cs c",
    "sc": f"SELECT term, doc_id, {BM25().sql()} AS score FROM base",
    "mx": "SELECT GREATEST(CAST(0 AS FLOAT), max(score)) AS max_score FROM sc",
    "imp": f"SELECT term, doc_id, {LinearQuantizer(_BITS).sql()} AS impact FROM sc, mx",
    "impi": f"SELECT term, doc_id, {scoring.saturated_sql()} AS impact FROM post",
    "dir": "SELECT term, impact, count(*) AS count FROM imp GROUP BY term, impact",
    "diri": "SELECT term, impact, count(*) AS count FROM impi GROUP BY term, impact",
}
_BASE = ("tok", "post", "dl", "cs", "tdf", "base", "sc", "mx", "imp", "dir")


def _with(parts: dict[str, str], final: str, names: tuple[str, ...] = _BASE) -> str:
    every = {n: _CTE[n] for n in names} | parts
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in every.items()) + f"\n{final}"


def _planned(weighted: bool, directory: str = "dir", source: str = _BENCHMARK) -> dict[str, str]:
    return _queries_cte(source, weighted) | {
        "pl": f"SELECT q.qid, q.pos, q.token, d.impact, q.weight, d.count, CAST(d.impact AS BIGINT) * q.weight AS level FROM {directory} d JOIN qt q ON q.token = d.term",
        "pr": "SELECT *, coalesce(sum(count) OVER (PARTITION BY qid ORDER BY level DESC, pos, impact DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, sum(count) OVER (PARTITION BY qid) AS total FROM pl",
    }


def _budget(mode: Mode) -> str:
    if mode.exhaustive:
        return "TRUE"
    return f"prior <= {scoring.fraction_budget_sql('total', mode.fraction) if mode.fraction is not None else mode.fixed}"


def _searched(mode: Mode, weighted: bool, postings: str = "imp", directory: str = "dir", k: int = K, pad: bool = False) -> dict[str, str]:
    acc = f"SELECT s.qid, i.doc_id, CAST(sum(s.level) AS BIGINT) AS score FROM (SELECT * FROM pr WHERE {_budget(mode)}) s JOIN {postings} i ON i.term = s.token AND i.impact = s.impact GROUP BY s.qid, i.doc_id HAVING sum(s.level) > 0"
    parts = _planned(weighted, directory) | {"acc": acc}
    source = "acc"
    if pad:
        parts["zero"] = f"SELECT q.qid, CAST(r.range AS INTEGER) AS doc_id, CAST(0 AS BIGINT) AS score FROM (SELECT DISTINCT qid FROM qt) q, range({k}) r WHERE r.range < (SELECT count(*) FROM dl)"
        parts["accp"] = "SELECT * FROM acc UNION ALL SELECT z.* FROM zero z ANTI JOIN acc a ON a.qid = z.qid AND a.doc_id = z.doc_id"
        source = "accp"
    parts["rk"] = f"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM {source}"
    parts["res"] = f"SELECT qid, rank, r.doc_id, d.ext_id, score FROM rk r JOIN dl d ON d.doc_id = r.doc_id WHERE rank <= {k}"
    return parts


_RESULTS = "SELECT qid, rank, doc_id, ext_id, score FROM res"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# ---- sources and statistics -----------------------------------------------------------------------------------------


@_query("postings", _with({}, "SELECT term, doc_id, tf FROM post", ("tok", "post")))
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.postings(table(spark, sf_dir, "documents"))


@_query("doc_lengths", _with({}, f"SELECT doc_id, ext_id, doc_len, {scoring.norm_len_sql()} AS norm_len FROM dl, cs", ("tok", "post", "dl", "cs")))
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.lengths(table(spark, sf_dir, "documents"))
    return docs.crossJoin(F.broadcast(segments.collection(docs))).select("doc_id", "ext_id", "doc_len", F.expr(scoring.norm_len_sql()).alias("norm_len"))


@_query("collection_stats", _with({}, "SELECT n, avg_len FROM cs", ("tok", "post", "dl", "cs")))
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.collection(text.lengths(table(spark, sf_dir, "documents")))


@_query("term_df", _with({}, "SELECT term, df FROM tdf", ("tok", "post", "tdf")))
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.frequencies(text.postings(table(spark, sf_dir, "documents")))


@_query("bm25_impacts", _with({}, "SELECT term, doc_id, impact FROM imp"))
def bm25_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return segments.impacts(text.counted(documents), segments.collection(text.lengths(documents)), BM25(), _BITS).postings


@_query("identity_impacts", _with({}, "SELECT term, doc_id, impact FROM impi", ("tok", "post", "impi")))
def identity_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return segments.impacts(text.counted(documents), segments.collection(text.lengths(documents)), Identity()).postings


@_query("max_score", _with({}, "SELECT CAST(round(CAST(max_score AS DOUBLE), 4) AS DOUBLE) AS max_score FROM mx"))
def max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats.select(F.round(F.col("max_score").cast("double"), 4).alias("max_score"))


@_query("segments", _with({}, "SELECT term, impact, count(*) AS count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM imp GROUP BY term, impact"))
def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.joined(index(spark, sf_dir).blocks)
    return rows.select("term", "impact", "count", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"))


@_query("segment_directory", _with({}, "SELECT term, impact, count FROM dir"))
def segment_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).directory


@_query("term_lookup", _with({}, "SELECT impact, count FROM dir WHERE term = 'the'"))
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).segment_list("the").select("impact", "count")


@_query(
    "index_stats",
    _with({}, f"SELECT c.n AS num_docs, c.avg_len, CAST({_BITS} AS INTEGER) AS quant_bits, CAST(sum(d.count) AS BIGINT) AS num_postings, count(DISTINCT d.impact) AS num_levels, max(d.impact) AS max_level, (SELECT max(doc_id) FROM dl) AS max_doc_id FROM dir d, cs c GROUP BY c.n, c.avg_len"),
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats.drop("max_score")


@_query("index_stats_identity", _with({}, "SELECT CAST(sum(count) AS BIGINT) AS num_postings, count(DISTINCT impact) AS num_levels, max(impact) AS max_level FROM diri", ("tok", "post", "impi", "diri")))
def index_stats_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, Identity()).stats.select("num_postings", "num_levels", "max_level")


@_query("docmap", _with({}, "SELECT doc_id, ext_id FROM dl", ("tok", "post", "dl")))
def docmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).docs.select("doc_id", "ext_id")


# ---- queries --------------------------------------------------------------------------------------------------------


@_query("parse_queries", _with(_queries_cte(_LINES, True), "SELECT qid, token, freq, pos FROM qm", ()))
def parse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_lines.bags(query_lines.parsed(conversation_lines(spark, sf_dir))).select("qid", "token", "freq", "pos")


@_query("rescale_weighted", _with(_queries_cte(_LINES, True), "SELECT qid, pos, token, weight FROM qt", ()))
def rescale_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_lines.from_lines(conversation_lines(spark, sf_dir), weighted=True)


@_query("rescale_unweighted", _with(_queries_cte(_LINES, False), "SELECT qid, pos, token, weight FROM qt", ()))
def rescale_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_lines.from_lines(conversation_lines(spark, sf_dir), weighted=False)


@_query("query_terms", _with(_queries_cte(_BENCHMARK, True), "SELECT qid, pos, token, weight FROM qt", ()))
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir, True)


@_query("unique_tokens", _with(_queries_cte(_BENCHMARK, True), "SELECT DISTINCT token FROM qt", ()))
def unique_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_lines.unique_tokens(terms(spark, sf_dir, True))


@_query(
    "cycle_queries",
    "WITH q AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark) SELECT r.range AS nth, q.item_id AS qid FROM range(1000) r JOIN q ON r.range % q.n = q.place",
)
def cycle_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_lines.cycled(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), 1000)


@_query("unknown_terms", _with(_queries_cte(_LINES, True), "SELECT qid, token FROM qt ANTI JOIN tdf ON tdf.term = qt.token", ("tok", "post", "tdf")))
def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.unknown(index(spark, sf_dir).terms, query_lines.from_lines(conversation_lines(spark, sf_dir), weighted=True))


@_query("segment_plan", _with(_planned(True), "SELECT qid, pos, token, impact, weight, count, level, CAST(prior AS BIGINT) AS prior, CAST(total AS BIGINT) AS total FROM pr"))
def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = terms(spark, sf_dir, True)
    return planning.with_prior(planning.planned(index(spark, sf_dir).of(own).directory, own))


@_query("postings_per_query", _with(_planned(False), "SELECT qid, CAST(sum(count) AS BIGINT) AS postings FROM pl GROUP BY qid"))
def postings_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = terms(spark, sf_dir, False)
    return planning.postings_per_query(planning.planned(index(spark, sf_dir).of(own).directory, own))


@_query(
    "selected_segments",
    _with(_planned(True), f"SELECT qid, pos, token, impact, weight, count, level FROM pr WHERE {_budget(Mode(fixed=1000))}"),
)
def selected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = terms(spark, sf_dir, True)
    return planning.selected(planning.planned(index(spark, sf_dir).of(own).directory, own), Mode(fixed=1000))


@_query(
    "warmup_segments",
    _with(_queries_cte(_BENCHMARK, True), "SELECT term, impact, count FROM (SELECT d.*, max(impact) OVER (PARTITION BY term) AS top FROM dir d SEMI JOIN qt ON qt.token = d.term) WHERE impact = top"),
)
def warmup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = terms(spark, sf_dir, True)
    return planning.warmup(index(spark, sf_dir).of(own).directory, own)


# ---- searches -------------------------------------------------------------------------------------------------------

_SEARCHES: dict[str, tuple[Mode, bool]] = {
    "search_exhaustive": (EXHAUSTIVE, False),
    "search_weighted": (EXHAUSTIVE, True),
    "search_fraction_0": (Mode(fraction=0.0), False),
    "search_fraction_10": (Mode(fraction=0.1), True),
    "search_fraction_50": (Mode(fraction=0.5), True),
    "search_fixed_0": (Mode(fixed=0), False),
    "search_fixed_1000": (Mode(fixed=1000), True),
    "search_fixed_negative": (Mode(fixed=-1), True),
}


def _search_query(mode: Mode, weighted: bool):
    return lambda spark, sf_dir: searches.search(index(spark, sf_dir), terms(spark, sf_dir, weighted), K, mode)


for _name, (_mode, _weighted) in _SEARCHES.items():
    _query(_name, _with(_searched(_mode, _weighted), _RESULTS))(_search_query(_mode, _weighted))


@_query("search_identity", _with(_searched(EXHAUSTIVE, True, "impi", "diri"), _RESULTS, ("tok", "post", "dl", "impi", "diri")))
def search_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search(index(spark, sf_dir, Identity()), terms(spark, sf_dir, True), K)


@_query("search_padded", _with(_searched(Mode(fraction=0.0), False, k=K, pad=True), _RESULTS))
def search_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search(index(spark, sf_dir), terms(spark, sf_dir, False), K, Mode(fraction=0.0), pad=True)


@_query("search_wrapped", _with(_searched(EXHAUSTIVE, True) | {
    "accw": "SELECT s.qid, i.doc_id, CAST(sum(s.level % 65536) AS BIGINT) % 65536 AS score FROM pr s JOIN imp i ON i.term = s.token AND i.impact = s.impact GROUP BY s.qid, i.doc_id",
    "rw": "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM accw WHERE score > 0",
}, f"SELECT qid, rank, rw.doc_id, d.ext_id, score FROM rw JOIN dl d ON d.doc_id = rw.doc_id WHERE rank <= {K}"))
def search_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search(index(spark, sf_dir), terms(spark, sf_dir, True), K, wrap=True)


@_query("search_pushed", _with(_searched(EXHAUSTIVE, False), _RESULTS))
def search_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search(index(spark, sf_dir), terms(spark, sf_dir, False), K, push=True)


@_query("accumulated_scores", _with(_searched(Mode(fixed=1000), True), "SELECT qid, doc_id, score FROM acc"))
def accumulated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.scores(index(spark, sf_dir), terms(spark, sf_dir, True), Mode(fixed=1000))


@_query("chunk_max", _with(_searched(EXHAUSTIVE, False), "SELECT qid, doc_id >> 7 AS chunk, max(score) AS max_score FROM acc GROUP BY qid, doc_id >> 7"))
def chunk_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.chunk_maxima(searches.scores(index(spark, sf_dir), terms(spark, sf_dir, False)))


@_query("scores_above", _with(_searched(EXHAUSTIVE, False), f"SELECT qid, doc_id, score FROM acc WHERE score > {THRESHOLD}"))
def scores_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.above(searches.scores(index(spark, sf_dir), terms(spark, sf_dir, False)), THRESHOLD)


@_query("score_max", _with(_searched(EXHAUSTIVE, False), f"SELECT qid, GREATEST(max(score), {10 * THRESHOLD}) AS largest FROM acc GROUP BY qid"))
def score_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.largest(searches.scores(index(spark, sf_dir), terms(spark, sf_dir, False)), 10 * THRESHOLD)


@_query("search_stored", _with(_searched(Mode(fraction=0.5), True), _RESULTS))
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "index")
    indexes.write(index(spark, sf_dir), path)
    return searches.search(indexes.read(spark, path), terms(spark, sf_dir, True), K, Mode(fraction=0.5), push=True)


@_query("search_bucketed", _with(_searched(Mode(fraction=0.1), True), _RESULTS))
def search_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a stored index, whose tables meet the batch by their buckets."""
    path = new_dir(spark, "index")
    indexes.write(index(spark, sf_dir), path)
    return searches.search(indexes.read(spark, path), terms(spark, sf_dir, True), K, Mode(fraction=0.1))


@_query("block_tops", _with({}, f"SELECT term, doc_id >> {FINE} AS block, max(impact) AS top, count(*) AS count FROM imp GROUP BY term, doc_id >> {FINE}"))
def block_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, block_bits=FINE).tops


@_query("search_skipping", _with(_searched(EXHAUSTIVE, False), _RESULTS))
def search_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search_skipping(index(spark, sf_dir, block_bits=FINE), terms(spark, sf_dir, False), K)


@_query("search_skipping_fraction", _with(_searched(Mode(fraction=0.5), True), _RESULTS))
def search_skipping_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search_skipping(index(spark, sf_dir, block_bits=FINE), terms(spark, sf_dir, True), K, Mode(fraction=0.5), seeds=2)


@_query("search_rounds", _with(_searched(EXHAUSTIVE, True), _RESULTS))
def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.search_rounds(index(spark, sf_dir, block_bits=FINE), terms(spark, sf_dir, True), K).results


# ---- interchange files ----------------------------------------------------------------------------------------------

def ciff_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents' postings as CIFF files; the folder has to be in a store that pyarrow opens."""
    documents, path = table(spark, sf_dir, "documents"), new_dir(spark, "ciff")
    ciff_sink.write(text.postings(documents), text.lengths(documents), path, "documents")
    return path


# ids in runs of 65,536 to a file, as the writer deals them
_CIFF_FILES = (
    f"SELECT d.doc_id >> {BLOCK_BITS} AS f, count(*) AS docs, sum(d.doc_len) AS total FROM dl d GROUP BY f",
    f"SELECT doc_id >> {BLOCK_BITS} AS f, count(DISTINCT term) AS lists FROM post GROUP BY f",
)


@_query(
    "ciff_header",
    _with(
        {"fd": _CIFF_FILES[0], "fl": _CIFF_FILES[1]},
        "SELECT CAST(1 AS INTEGER) AS version, CAST(coalesce(lists, 0) AS INTEGER) AS num_postings_lists, CAST(docs AS INTEGER) AS num_docs, CAST(total AS BIGINT) AS total_terms_in_collection, "
        "CAST(total AS DOUBLE) / docs AS average_doclength, 'documents' AS description FROM fd LEFT JOIN fl USING (f)",
        ("tok", "post", "dl"),
    ),
)
def ciff_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ciff.read(spark, ciff_files(spark, sf_dir), "header").select("version", "num_postings_lists", "num_docs", "total_terms_in_collection", "average_doclength", "description")


@_query("ciff_postings", ORACLES["postings"])
def ciff_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ciff_files(spark, sf_dir)
    return ciff.postings(ciff.read(spark, path, "postings"), single=ciff.single_lists(path))


@_query("ciff_docs", _with({}, "SELECT doc_id, ext_id, doc_len FROM dl", ("tok", "post", "dl")))
def ciff_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ciff.docs(ciff.read(spark, ciff_files(spark, sf_dir), "docs"))


@_query("ciff_index", _with({}, "SELECT term, impact, count FROM dir"))
def ciff_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.from_ciff(spark, ciff_files(spark, sf_dir)).directory


@_query(
    "ciff_lookup",
    _with(
        {
            "nb": f"SELECT doc_id >> {BLOCK_BITS} AS f, term, row_number() OVER (PARTITION BY doc_id >> {BLOCK_BITS} ORDER BY encode(term)) - 1 AS number FROM (SELECT DISTINCT doc_id >> {BLOCK_BITS} << {BLOCK_BITS} AS doc_id, term FROM post)",
        },
        f"SELECT p.term, p.doc_id, p.tf FROM post p JOIN nb ON nb.term = p.term AND nb.f = p.doc_id >> {BLOCK_BITS} WHERE nb.number % 1000 = 0",
        ("tok", "post"),
    ),
)
def ciff_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 1,000th list of each file, by its number, from the stored positions."""
    path = ciff_files(spark, sf_dir)
    ciff.positioned(spark, path, 0)
    numbers = [(f << ciff.FILE_BITS) + n for f, many in enumerate(ciff.sizes_of(path, "postings")) for n in range(0, many, 1000)]
    return ciff.postings(ciff.lookup(spark, path, "postings", numbers), single=ciff.single_lists(path))


# ---- requests, run files, measurements ------------------------------------------------------------------------------


_REQUESTS = _queries_cte(_BENCHMARK, True) | {
    "rq": f"SELECT qid, {', '.join(f'{x} AS {name}' for name, x in ASKED.items())} FROM (SELECT DISTINCT qid FROM qt)",
    "er": "SELECT qid, CASE WHEN k < 1 THEN 'k must be at least 1' WHEN rho > 1 THEN 'Fraction must be from 0 to 1' END AS error FROM rq",
}


@_query("request_errors", _with(_REQUESTS, """SELECT qid AS id, '{"error":"' || error || '"}' AS response FROM er, range(2) WHERE error IS NOT NULL""", ()))
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = requests.error_bodies(requests.parsed(request_rows(spark, sf_dir)))
    return bodies.select(F.get_json_object("body", "$.query.id").cast("long").alias("id"), "response")


@_query(
    "request_results",
    _with(
        _REQUESTS
        | {
            "pl": "SELECT q.qid, q.pos, q.token, d.impact, d.count, CAST(d.impact AS BIGINT) * q.weight AS level, r.k, r.rho, r.fixed FROM dir d JOIN qt q ON q.token = d.term JOIN rq r ON r.qid = q.qid JOIN er e ON e.qid = q.qid WHERE e.error IS NULL",
            "pr": "SELECT *, coalesce(sum(count) OVER (PARTITION BY qid ORDER BY level DESC, pos, impact DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, sum(count) OVER (PARTITION BY qid) AS total FROM pl",
            "acc": "SELECT s.qid, any_value(s.k) AS k, i.doc_id, CAST(sum(s.level) AS BIGINT) AS score FROM (SELECT * FROM pr WHERE prior <= CASE WHEN rho = 1 THEN total WHEN rho IS NOT NULL THEN ceil(CAST(total AS FLOAT) * CAST(rho AS FLOAT)) ELSE fixed END) s "
            "JOIN imp i ON i.term = s.token AND i.impact = s.impact GROUP BY s.qid, i.doc_id HAVING sum(s.level) > 0",
            "rk": "SELECT qid, k, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM acc",
        },
        "SELECT qid, rank, r.doc_id, d.ext_id, score FROM rk r JOIN dl d ON d.doc_id = r.doc_id, range(2) WHERE rank <= k",
    ),
)
def request_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.answered(index(spark, sf_dir), request_rows(spark, sf_dir))


@_query("stream_results", ORACLES["request_results"])
def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests, arriving as a stream."""
    source, out = new_dir(spark, "requests"), new_dir(spark, "answers")
    request_rows(spark, sf_dir).write.text(source)
    query = serve.serve(index(spark, sf_dir), spark.readStream.text(source), lambda rows, _: rows.write.mode("append").parquet(out), checkpoint=new_dir(spark, "offsets"))
    query.awaitTermination()
    return spark.read.schema(RESULTS).parquet(out)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.search(index(spark, sf_dir), terms(spark, sf_dir, False), K)


@_query("trec_run", _with(_searched(EXHAUSTIVE, False), "SELECT qid, rank, qid || ' Q0 ' || ext_id || ' ' || rank || ' ' || score || ' loomrank' AS value FROM res"))
def trec_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.trec(_results(spark, sf_dir))


@_query("tsv_run", _with(_searched(EXHAUSTIVE, False), "SELECT qid, rank, qid || ' ' || ext_id || ' ' || rank AS value FROM res"))
def tsv_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.tsv(_results(spark, sf_dir))


@_query(
    "result_display",
    _with(_searched(EXHAUSTIVE, False), "SELECT qid, 'query ' || qid || ' took: 0ms [' || string_agg('#' || rank || ',(' || doc_id || ',' || score || ')', ',' ORDER BY rank) || ']' AS value FROM res GROUP BY qid"),
)
def result_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.display(_results(spark, sf_dir))


@_query(
    "result_json",
    _with(
        _searched(EXHAUSTIVE, False),
        """SELECT qid, '{"topk":[' || string_agg('{"doc_id":' || doc_id || ',"score":' || score || '}', ',' ORDER BY rank) || '],"took":{"secs":0,"nanos":0},"qid":0}' AS value FROM res GROUP BY qid""",
    ),
)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.json(_results(spark, sf_dir))


@_query(
    "latency_summary",
    "WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT count(*) AS samples, "
    + ", ".join(f"max(CASE WHEN r = CAST(floor(CAST(n AS FLOAT) * CAST({p} AS FLOAT)) AS BIGINT) THEN x END) AS {name}" for name, p in latency.SHARES.items())
    + ", max(x) AS max, round(avg(x), 6) AS mean FROM s",
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.summary(table(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6))


@_query(
    "latency_without_warmup",
    f"SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS nth FROM events) WHERE nth > {latency.SKIPPED}",
)
def latency_without_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.without_warmup(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")


_RANKED = "WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value AS x, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value) - 1 AS r, count(value) OVER (PARTITION BY strftime(ts, '%Y-%m-%d')) AS n FROM events)"


@_query(
    "latency_windows",
    f"{_RANKED} SELECT day, count(x) AS samples, count(*) - count(x) AS errors, "
    + ", ".join(f"max(CASE WHEN r = least(n - 1, CAST(floor(CAST(n AS FLOAT) * CAST({p} AS FLOAT)) AS BIGINT)) THEN x END) AS {name}" for name, p in latency.SHARES.items())
    + ", max(x) AS max, round(avg(x), 6) AS mean FROM s GROUP BY day",
)
def latency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of measured times, by day."""
    source, out = new_dir(spark, "events"), new_dir(spark, "windows")
    table(spark, sf_dir, "events").write.parquet(source)  # streams read folders, and the table may be a file
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(source)
    stream = stream.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))  # days are UTC's in any session
    query = stream_latency.watched(stream, "ts", ["value"], lambda rows, _: rows.write.mode("overwrite").parquet(out), width="1 day", whole=True, checkpoint=new_dir(spark, "offsets"))
    query.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select(F.date_from_unix_date(F.floor(F.unix_micros("began") / 86_400_000_000).cast("int")).cast("string").alias("day"), "samples", "errors", *latency.SHARES, "max", F.round("mean", 6).alias("mean"))


# ---- encodings ------------------------------------------------------------------------------------------------------

_GAPS = {
    "gp": "SELECT term, impact, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, impact ORDER BY doc_id) AS gap, (row_number() OVER (PARTITION BY term, impact ORDER BY doc_id) - 1) // 128 AS part FROM imp",
    "bt": f"SELECT term, impact, part, {codec.bit_width_sql('gap')} AS bits, {codec.byte_width_sql('gap')} AS width FROM gp",
    "ps": "SELECT term, impact, part, count(*) AS count, max(bits) AS bits, CAST(sum(width) AS BIGINT) AS data FROM bt GROUP BY term, impact, part",
    "bs": f"SELECT term, impact, part, count, bits, CAST(CASE WHEN count = {codec.BLOCK_LEN} THEN {codec.full_block_sql('bits')} ELSE {codec.tail_sql('count', 'data')} END AS BIGINT) AS bytes, {codec.plain_sql('count')} AS plain_bytes FROM ps",
}


@_query("delta_gaps", _with(_GAPS, "SELECT term, impact, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY doc_id) AS gaps FROM gp GROUP BY term, impact"))
def delta_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoding.with_gaps(index(spark, sf_dir).blocks)
    parts = rows.groupBy("term", "impact").agg(F.sort_array(F.collect_list(F.struct("block", "gaps"))).alias("parts"))
    return parts.select("term", "impact", F.array_join(F.flatten("parts.gaps").cast("array<string>"), ",").alias("gaps"))


@_query("delta_roundtrip", _with({}, "SELECT term, impact, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM imp GROUP BY term, impact"))
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.joined(encoding.restored(encoding.with_gaps(index(spark, sf_dir).blocks)))
    return rows.select("term", "impact", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"))


@_query("block_bits", _with(_GAPS, "SELECT term, impact, part, count, CAST(bits AS INTEGER) AS bits, bytes, plain_bytes FROM bs"))
def block_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.block_sizes(encoding.with_gaps(index(spark, sf_dir).blocks))


@_query("segment_bytes", _with(_GAPS, "SELECT term, impact, CAST(sum(count) AS BIGINT) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(plain_bytes) AS BIGINT) AS plain_bytes FROM bs GROUP BY term, impact"))
def segment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.segment_sizes(encoding.with_gaps(index(spark, sf_dir).blocks))


@_query("capacity", _with(_GAPS, "SELECT CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(plain_bytes) AS BIGINT) AS plain_bytes FROM bs"))
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.segment_sizes(encoding.with_gaps(index(spark, sf_dir).blocks)).agg(F.sum("bytes").alias("bytes"), F.sum("plain_bytes").alias("plain_bytes"))
