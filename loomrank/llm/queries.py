"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm import bit_sliced, first_fit, merkle, near_dedup, packing, page_text, piece_codec, prefix_forest, scratch, sharding, spelling, suffix_dedup, toxicity, warc
from loomrank.llm.oracles import MANIFEST, VARIANTS


def tokenizer(name: str) -> str:
    """Where the installation keeps a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), length=200)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), percent=75)


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extracted(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path, least=0)
    found = warc.read(spark, path, payloads=False).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"), fanout=8, every=3)


def op12_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_fit.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), least=5, times=3, one_in=97), ratio=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_page_text": op5_page_text,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_piece_codec": op9_piece_codec,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_first_fit_packing": op12_first_fit_packing,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
        ), p AS (SELECT doc_id, x, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200
        ), h AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS h FROM p
        ), c AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1
        ), m AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM h SEMI JOIN c ON c.h = h.h
        ), g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM m
        ), r AS (SELECT doc_id, g, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY doc_id, g
        ), k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r
        ), t AS (SELECT k.doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
        SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(t.kept, '') || substr(d.x, 2 * coalesce(t.last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS shingle
            FROM w
        ), n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
        ), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
        ), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
        SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id, n.doc_id = min(r.seen) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op7_warc": """
        WITH d AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages
        ), f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h
        ), v AS (SELECT d.*, f.first, list_transform(range(32), lambda i: 16 * (instr('0123456789abcdef', substr(d.h, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) + greatest(0, instr('0123456789abcdef', nullif(substr(d.h, CAST(5 * i // 4 + 2 AS BIGINT), 1), '')) - 1)) AS pairs FROM d JOIN f ON f.h = d.h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((pairs[i + 1] >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM v""",
    "op11_merkle_manifest": MANIFEST,
    "op13_spelling_variants": VARIANTS,
}
