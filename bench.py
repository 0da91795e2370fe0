"""Headline times: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose input and cores.
Building is timed cold; searches run on an index that is there, as a server's do.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomrank import catalogue  # noqa: E402

SEARCHES = ("search_exhaustive", "search_weighted", "search_fraction_10", "search_fixed_1000", "search_identity", "search_padded", "trec_run", "segment_plan", "chunk_max", "capacity")


def timed(f) -> tuple[float, int]:
    start = time.perf_counter()
    rows = f()
    return round(time.perf_counter() - start, 3), rows


def noop(df) -> int:
    df.write.format("noop").mode("overwrite").save()
    return 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start isn't measured
    index = None

    def build() -> int:
        nonlocal index
        index = catalogue.index(spark, sf_dir)
        index.directory.count()
        index.blocks.count()
        return index.getter("num_postings")

    queries["build_index"], postings = timed(build)
    for name in SEARCHES:
        queries[name], _ = timed(lambda: noop(catalogue.QUERIES[name](spark, sf_dir)))
    batch = catalogue.terms(spark, sf_dir, False).select("qid").distinct().count()
    warm, _ = timed(lambda: noop(catalogue.QUERIES["search_exhaustive"](spark, sf_dir)))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "postings": postings, "postings_per_sec": round(postings / queries["build_index"]), "queries_per_sec": round(batch / warm, 1), "ms_per_query": round(1000 * warm / batch, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
