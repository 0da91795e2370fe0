"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Paths that saved() has written and drop() or sweep() hasn't deleted, oldest first.
_written: list[str] = []
_ends_with: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set (tests, local mode), a temporary folder set once."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomrank-")
        try:
            spark.conf.set(_KEY, base)
        except Exception:  # a static setting here: keep it with the context instead
            spark.sparkContext.getConf().set(_KEY, base)
        spark.sparkContext._conf.set(_KEY, base)
    return base.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomrank-{spark.sparkContext.applicationId}"


def _gone_at_exit(spark: SparkSession) -> None:
    """Scratch tables go when the driver ends, unless Spark has stopped before."""

    def clean() -> None:
        with contextlib.suppress(Exception):
            delete(spark, run_dir(spark))

    if spark.sparkContext.applicationId not in _ends_with:
        _ends_with.add(spark.sparkContext.applicationId)
        atexit.register(clean)


def new_path(spark: SparkSession, name: str) -> str:
    _gone_at_exit(spark)
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it again: later plans start from files that outlive any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by saved() that nothing reads any more."""
    _written.remove(df.scratch_path)
    delete(df.sparkSession, df.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def mark() -> int:
    return len(_written)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables; for when every result that reads them has been written."""
    for path in paths:
        if path in _written:
            _written.remove(path)
            delete(spark, path)
    release(spark)


def since(start: int) -> list[str]:
    """The tables written since mark() that are still there."""
    return _written[start:]
