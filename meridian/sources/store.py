"""Tables at rest: encounters by date, density as mergeable partials by hour."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from .shared import discard


#: what is taken of an encounter message, as text
MESSAGE = "encounter_time string, user1_id string, user2_id string, position struct<lat: string, lng: string>"


def encounter_rows(messages: DataFrame) -> DataFrame:
    """JSON encounter messages as flat rows, read once each, times and numbers by best effort."""
    read = messages.select(F.from_json(F.col("value").cast("string"), MESSAGE).alias("m"))
    return read.select(
        parse.event_time(F.col("m.encounter_time")).alias("encounter_time"),
        F.coalesce("m.user1_id", F.lit("")).alias("user1_id"),
        F.coalesce("m.user2_id", F.lit("")).alias("user2_id"),
        *[F.coalesce(F.col(f"m.position.{c}").try_cast("double"), F.lit(0.0)).alias(c) for c in ("lat", "lng")],
    )


def append_encounters(rows: DataFrame, path: str, spread: bool = True) -> None:
    """Add encounters to the table, in a folder for each date, each file sorted by time.

    Rows are rebalanced by date: small dates share a task, a large one is divided among several.
    Without ``spread`` each task writes its rows itself, unshuffled, for few dates of many rows.
    """
    dated = rows.withColumn("date", F.to_date("encounter_time"))
    dated = dated.hint("rebalance", F.col("date")) if spread else dated
    dated.sortWithinPartitions("date", "encounter_time").write.mode("append").partitionBy("date").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_partials(counts: DataFrame, path: str, block: str) -> None:
    """Add a block of (hour, cell, visitors) as partial sums, in the folder of its name.

    The block's name is its identity: written again (a batch that is replayed), it takes
    the place of what it wrote before, so nothing counts twice.
    """
    partial = counts.groupBy("hour", "cell").agg(F.sum("visitors").alias("visitors"))
    partial.withColumn("date", F.to_date("hour")).write.mode("overwrite").partitionBy("date").parquet(f"{path}/block={block}")


def merged(partials: DataFrame) -> DataFrame:
    """The final value of each (hour, cell)."""
    return partials.groupBy("hour", "cell").agg(F.sum("visitors").alias("visitors"))


def compact(spark: SparkSession, path: str, into: str, block: str | None = None) -> DataFrame:
    """All blocks of a partial table merged into one table by date, sorted by hour and cell.

    With ``block`` only the dates that this block has are merged again, from all blocks: what
    a new block costs doesn't grow with the table. (A block that was written again without
    dates that it had before asks for a full run.)

    What is merged is written to a folder of its own, then a manifest that names a folder for
    each date is put in place by one rename. Readers (snapshot()) follow the newest manifest,
    so they see the table before or after, never between; a run that fails leaves it as it
    was, and of two runs at once the second to publish fails.
    """
    partials, before, number = read(spark, path), {}, _newest(spark, into)
    if block is not None:
        touched = read(spark, f"{path}/block={block}").select(F.col("date").alias("touched")).distinct()
        partials = partials.join(touched, F.col("date").eqNullSafe(F.col("touched")), "left_semi")
        before = _manifest(spark, into, number) if number else {}
    whole = merged(partials).withColumn("date", F.to_date("hour")).hint("rebalance", F.col("date")).sortWithinPartitions("date", "hour", "cell")
    folder = f"merged-{uuid.uuid4().hex}"
    whole.write.partitionBy("date").parquet(f"{into}/{folder}")
    dates = {p: folder for p in _listed(spark, f"{into}/{folder}") if p.startswith("date=")}
    _publish(spark, into, number + 1, before | dates)
    return snapshot(spark, into)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop, so that any store works."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, there = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(there)) if fs.exists(there) else []


def _newest(spark: SparkSession, into: str) -> int:
    """The number of the newest manifest; 0 without any."""
    return max((int(n[9:-5]) for n in _listed(spark, into) if n.startswith("manifest-") and n.endswith(".json")), default=0)


def _manifest(spark: SparkSession, into: str, number: int) -> dict[str, str]:
    """Folder by date of a manifest: a row a date."""
    fs, there = _hadoop(spark, f"{into}/manifest-{number:010d}.json")
    stream = fs.open(there)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, into: str, number: int, dates: dict[str, str]) -> None:
    """Put a manifest in place by a rename, which fails if that number is there already."""
    fs, draft = _hadoop(spark, f"{into}/_draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(dates).encode()))
    stream.close()
    _, place = _hadoop(spark, f"{into}/manifest-{number:010d}.json")
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"manifest {number} of {into} was published by another run")


def snapshot(spark: SparkSession, into: str, number: int | None = None) -> DataFrame:
    """(hour, cell, visitors) of a merged table, as its newest manifest (or a numbered one) says."""
    number = number or _newest(spark, into)
    dates = _manifest(spark, into, number) if number else {}
    schema = "hour timestamp, cell string, visitors bigint"
    if not dates:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{into}/{folder}/{date}" for date, folder in sorted(dates.items())])


def vacuum(spark: SparkSession, into: str, keep: int = 2) -> None:
    """Delete manifests but the newest ``keep``, and folders that none of these names (as runs that failed leave)."""
    newest, names = _newest(spark, into), _listed(spark, into)
    kept = [n for n in range(max(1, newest - keep + 1), newest + 1) if f"manifest-{n:010d}.json" in names]
    used = {folder for n in kept for folder in _manifest(spark, into, n).values()}
    stays = {f"manifest-{n:010d}.json" for n in kept} | used
    for name in names:
        if name not in stays and name.startswith(("manifest-", "merged-", "_draft-")):
            discard(spark, f"{into}/{name}")


def save_sketches(sketches: DataFrame, path: str, block: str) -> None:
    """Add a block of (hour, cell, sketch); sketches of any blocks merge without counting twice."""
    sketches.write.mode("overwrite").parquet(f"{path}/block={block}")
