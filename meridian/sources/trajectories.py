"""Trajectory and label files, one folder per user."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from .store import _hadoop

FIELDS = 7  # lat, lng, a constant, altitude, day number, date, time
#: files are put in their folders by the tasks, not one after another by the driver
PLACED = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: characters that Spark writes as numbers in the names of folders
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def user_of(pattern: str):
    """The user's name in a file's path."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("user_id")


def write_files(lines: DataFrame, path: str) -> None:
    """(user_id, file, value) as text in a folder ``user_id=...`` for each user; a file's lines lie together in one task.

    On a local file system tasks write the files themselves: for each one that Spark's writer
    makes there, Hadoop starts eight processes to set and ask for permissions.
    """
    fs, there = _hadoop(lines.sparkSession, path)
    if fs.getScheme() != "file":
        lines.select("user_id", "value").write.options(**PLACED).partitionBy("user_id").text(path)
        return
    root = there.toUri().getPath()

    @contextmanager
    def opened(user: str | None, file: str | None):
        """A file of the user, in place once it is whole, so that a task may be repeated."""
        name = "__HIVE_DEFAULT_PARTITION__" if user is None else ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", user)
        folder = f"{root}/user_id={name}"
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/.part-{file}-{TaskContext.get().taskAttemptId()}"
        with open(draft, "wb") as out:
            yield out
        os.replace(draft, f"{folder}/part-{file}.txt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[tuple[str | None, str | None], list[str]]]:
            for batch in batches:
                keys = [c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
                begins = np.flatnonzero(np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))) if batch.num_rows else []
                values = batch.column(2).to_pylist()
                for begin, end in pairwise([*begins, batch.num_rows]):
                    yield (batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py()), values[begin:end]

        files = 0
        for key, parts in groupby(runs(), key=lambda x: x[0]):
            with opened(*key) as out:
                for _, values in parts:
                    out.write("".join(f"{v}\n" for v in values).encode())
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files])], names=["files"])

    lines.select("user_id", "file", "value").mapInArrow(run, "files long").agg(F.sum("files")).first()


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed(spark: SparkSession, root: str, files: str) -> Iterator[tuple[DataFrameReader, str]]:
    """A reader of the files that a pattern names, and the pattern of their folders.

    Folders are listed by tasks, each many of them, and not one after another by the driver.
    """
    folders, _, name = files.rpartition("/")
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield spark.read.option("pathGlobFilter", name), f"{root}/{folders}"
    finally:
        spark.conf.set(LISTING, before)


def trajectories(spark: SparkSession, root: str, files: str = "*/Trajectory/*.plt", user: str = "([^/]+)/Trajectory/") -> DataFrame:
    """(user_id, event_time, lat, lng, altitude) of all trajectory files below root.

    The six lines before the data have other than seven fields or no time, so files
    needn't be read as wholes to skip them. Lines that can't be parsed are left out.
    """
    with listed(spark, root, files) as (reader, folders):
        lines = reader.text(folders).select("value", user_of(user))
    parts = F.split(F.col("value"), ",")
    number = lambda i: F.get(F.col("p"), F.lit(i)).try_cast("double")
    when = parse.pattern_time(F.concat_ws(" ", F.get(F.col("p"), F.lit(5)), F.trim(F.get(F.col("p"), F.lit(6)))), "yyyy-MM-dd HH:mm:ss")
    rows = lines.withColumn("p", parts).filter(F.size("p") == FIELDS)
    rows = rows.select("user_id", when.alias("event_time"), number(0).alias("lat"), number(1).alias("lng"), number(3).alias("altitude"))
    return rows.filter(F.col("event_time").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull())


def labels(spark: SparkSession, root: str, files: str = "*/labels.txt", user: str = "([^/]+)/labels\\.txt") -> DataFrame:
    """(user_id, start_time, end_time, label) of all label files below root."""
    with listed(spark, root, files) as (reader, folders):
        lines = reader.option("sep", "\t").option("header", True).schema("start string, end string, label string").csv(folders)
    time = lambda c: parse.pattern_time(F.col(c), "yyyy/MM/dd HH:mm:ss")
    return lines.select(user_of(user), time("start").alias("start_time"), time("end").alias("end_time"), F.trim("label").alias("label"))


def of_labelled_users(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points of users that have a label."""
    return points.join(intervals.select("user_id").distinct(), "user_id", "left_semi")
