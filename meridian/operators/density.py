"""Visitors per grid cell and hour."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import chunks


def located(pings: DataFrame) -> DataFrame:
    """(id, hour, cell): pings by hour and cell; a ping without a place has a null cell."""
    return pings.select("id", F.date_trunc("hour", "event_time").alias("hour"), geo.cell_id(F.col("lat"), F.col("lng")).alias("cell"))


def estimated(c: str) -> Column:
    """About how many distinct values a column has, by a HyperLogLog sketch.

    A sketch keeps a small set as it is, so few values are counted as they are, and many with a
    standard error under 2 %. (Registers alone take two of nine for one in one cell of fourteen.)
    """
    return F.hll_sketch_estimate(F.hll_sketch_agg(c))


def hourly(pings: DataFrame, approximate: bool = False) -> DataFrame:
    """(hour, cell, visitors): distinct ids, exact or estimated()."""
    count = estimated("id") if approximate else F.count_distinct("id")
    return located(pings).groupBy("hour", "cell").agg(count.alias("visitors"))


def sketches(pings: DataFrame) -> DataFrame:
    """(hour, cell, sketch): mergeable state of the distinct ids."""
    return located(pings).groupBy("hour", "cell").agg(F.hll_sketch_agg("id").alias("sketch"))


def from_sketches(parts: DataFrame) -> DataFrame:
    """(hour, cell, visitors) from sketches of any parts, which may overlap."""
    return parts.groupBy("hour", "cell").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"))


def recent(density: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Visitors summed by hour and cell over the last full hours before now, by hour."""
    end = now.replace(minute=0, second=0, microsecond=0)
    begin = end - timedelta(hours=hours)
    inside = density.filter((F.col("hour") >= F.lit(str(begin)).cast("timestamp")) & (F.col("hour") < F.lit(str(end)).cast("timestamp")))
    return inside.groupBy("hour", "cell").agg(F.sum("visitors").alias("visitors")).orderBy("hour", "cell")


def by_hour(density: DataFrame) -> DataFrame:
    """(hour, cells): the cells of each hour as a sorted list of (cell, visitors)."""
    return density.groupBy("hour").agg(F.sort_array(F.collect_list(F.struct("cell", "visitors"))).alias("cells"))


def by_hour_chunks(density: DataFrame, most: int = chunks.MOST) -> DataFrame:
    """(hour, part, cells): by_hour() in rows of at most ``most`` cells; joined in order of part they are its list."""
    return chunks.chunked(density, "hour", ["cell", "visitors"], F.struct("cell", "visitors"), "cells", most)


def hours(density: DataFrame) -> DataFrame:
    return density.select("hour").distinct().orderBy("hour")


def of_hour(density: DataFrame, hour: datetime) -> DataFrame:
    return density.filter(F.col("hour") == F.lit(str(hour)).cast("timestamp")).select("cell", "visitors")


def congestion(density: DataFrame) -> DataFrame:
    """density with ``level``: red over 0.66 of the largest count of all hours, amber over 0.33, else green."""
    # the right side is one row
    most = density.agg(F.max("visitors").alias("most"))
    level = F.when(F.col("visitors") > F.col("most") * F.lit(0.66), "red").when(F.col("visitors") > F.col("most") * F.lit(0.33), "amber").otherwise("green")
    return density.crossJoin(F.broadcast(most)).withColumn("level", level).drop("most")


def bounding_box(density: DataFrame) -> DataFrame:
    """One row: the box around all cells."""
    edges = density.select(geo.cell_bounds(F.col("cell")).alias("b"))
    return edges.agg(F.min("b.south").alias("south"), F.min("b.west").alias("west"), F.max("b.north").alias("north"), F.max("b.east").alias("east"))
