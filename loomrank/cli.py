"""Command line: create an index, query it."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomrank.functions.scoring import BM25, Identity
from loomrank.operators import planning
from loomrank.operators.planning import Mode
from loomrank.plans import index as indexes
from loomrank.plans import search as searches
from loomrank.plans.throughput import timed
from loomrank.sinks import runs
from loomrank.sources import query_lines

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomrank", description="impact-ordered indexes on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create", help="build an index from a CIFF file")
    create.add_argument("--input", required=True)
    create.add_argument("--output", required=True)
    create.add_argument("--quantize", action="store_true", help="score by BM25 and quantise; otherwise frequencies are impacts")
    create.add_argument("--bm25-k1", type=float, default=0.9)
    create.add_argument("--bm25-b", type=float, default=0.4)
    create.add_argument("--quant-bits", type=int, default=8)
    query = commands.add_parser("query", help="search an index for the queries of a file")
    query.add_argument("--index", required=True)
    query.add_argument("--queries", required=True)
    query.add_argument("--mode", type=Mode.parse, required=True, help="fraction-<share> or fixed-<postings>")
    query.add_argument("--k", type=int, default=10)
    query.add_argument("--num-queries", type=int, help="so many queries, cycling through the file")
    query.add_argument("--output-file")
    query.add_argument("--warmup", action="store_true")
    query.add_argument("--weighted", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomrank").getOrCreate()
    if args.command == "create":
        scorer = BM25(args.bm25_k1, args.bm25_b) if args.quantize else Identity()
        indexes.write(indexes.from_ciff(spark, args.input, scorer, args.quant_bits), args.output)
        return 0
    index = indexes.read(spark, args.index)
    terms = query_lines.read(spark, args.queries, args.weighted)
    if args.num_queries is not None:
        taken = query_lines.cycled(terms.select("qid").distinct(), args.num_queries).select("qid").distinct()
        terms = terms.join(taken, "qid", "left_semi")
    terms = terms.persist()
    for row in planning.unknown(index.directory, terms).toLocalIterator():  # every one, a partition at a time
        log.warning("query %d: unknown token %s", row["qid"], row["token"])
    warm = searches.warmed(index, terms) if args.warmup else None
    results = searches.search(index, terms, args.k, args.mode, push=True, warm=warm).persist()
    seconds, rows = timed(results.count)
    if args.output_file:
        runs.write(runs.trec(results), args.output_file)
    queries = terms.agg(F.countDistinct("qid")).first()[0]
    print(f"{queries} queries, {rows} results, {seconds:.3f} s, {queries / max(seconds, 1e-9):.1f} queries/s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
