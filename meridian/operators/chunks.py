"""Long ordered groups as numbered chunks, so that no row grows with its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

MOST = 1000


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``place``: their number (from 0) in their group's order.

    Rows are sorted by range over all partitions, so a large group has several tasks; each
    numbers its own part, from where those before it end (a small table of counts).
    """
    # the number only parts equal rows
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(group), *order, F.col("_tie"))
    dealt = stored(dealt.withColumn("_run", F.spark_partition_id()), "sorted")
    counts = dealt.groupBy(group, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(F.col(group).alias("_group"), F.col("_run").alias("_of"), F.coalesce(before, F.lit(0)).alias("_begin"))
    own = F.row_number().over(Window.partitionBy(group, "_run").orderBy(*order, "_tie"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_run") == F.col("_of"))
    return dealt.withColumn("_own", own).join(begins, same).withColumn("place", F.col("_begin") + F.col("_own") - 1).select(*rows.columns, "place")


def chunked(rows: DataFrame, group: str, order: list[str], item: Column, name: str, most: int = MOST) -> DataFrame:
    """(group, part, name): each group's items in order, at most ``most`` in a row; parts count from 0."""
    placed = numbered(rows, group, order).withColumn("part", F.floor(F.col("place") / most).cast("int"))
    items = F.sort_array(F.collect_list(F.struct("place", item.alias("_item"))))
    return placed.groupBy(group, "part").agg(F.transform(items, lambda x: x["_item"]).alias(name))
