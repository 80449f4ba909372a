"""The folder that driver and executors share, and tables that cut lineage in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session has none (tests, one machine) a local folder is set."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(there)
    return there


#: for each open scope() the paths that were made in it
_MADE: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables made inside are deleted when it ends well, but for the paths that are put on the list it gives.

    For work whose result is written before the scope ends; what is still to be read stays.
    """
    made: list[str] = []
    kept: list[str] = []
    _MADE.append(made)
    try:
        yield kept
    finally:
        _MADE.remove(made)
    for path in made:
        if path not in kept:
            discard(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read back: cuts lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to a table of its own in the shared folder."""
    return written(df, fresh_path(df.sparkSession, label))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later step reads, on whatever file system it is."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
