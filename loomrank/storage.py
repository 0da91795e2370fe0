"""Folders that executors share, and tables in them that count only once they are whole.

A table's files are written first and its manifest last: a line for every file with
its length.  Readers compare the manifest with what is there, so a write that was cut
short, a lost file and a file of another write are refused instead of being read in part.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


class Incomplete(ValueError):
    """A folder whose files aren't those that its manifest names."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomrank-')}"
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: what follows starts from files that outlive any executor."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """name and length of the files of a folder, from its listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def commit(spark: SparkSession, path: str, tables: list[str], facts: dict) -> None:
    """Writes the manifest of a folder's tables as its last file; facts are what readers need to know besides."""
    rows = [(table, r["name"], r["length"]) for table in tables for r in listed(spark, f"{path}/{table}").collect()]
    lines = [json.dumps(facts), *(json.dumps({"table": t, "name": n, "length": x}) for t, n, x in rows)]
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "nth long, value string").coalesce(1).sortWithinPartitions("nth").select("value").write.text(f"{path}/{MANIFEST}")


def lengths(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes by table, from a manifest."""
    out: dict[str, int] = {}
    for x in (json.loads(r["value"]) for r in spark.read.text(f"{path}/{MANIFEST}").collect()):
        if "table" in x:
            out[x["table"]] = out.get(x["table"], 0) + x["length"]
    return out


def committed(spark: SparkSession, path: str) -> dict:
    """The facts of a folder, once its files have been found to be those of its manifest."""
    try:
        lines = [json.loads(r["value"]) for r in spark.read.text(f"{path}/{MANIFEST}").collect()]
    except Exception as e:
        raise Incomplete(f"{path} has no manifest: its write didn't end") from e
    facts = next(x for x in lines if "table" not in x)
    for table in sorted({x["table"] for x in lines if "table" in x}):
        want = {x["name"]: x["length"] for x in lines if x.get("table") == table}
        got = {r["name"]: r["length"] for r in listed(spark, f"{path}/{table}").collect()}
        if got != want:
            wrong = sorted(n for n in want.keys() | got.keys() if want.get(n) != got.get(n))
            raise Incomplete(f"{path}/{table} isn't what was written: {wrong[0]} and {len(wrong) - 1} others")
    return facts
