"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of one key that spread_join() deals out, as a part of all rows, and to how many places
HOT, SPREAD = 256, 64


def hot_values(counted: DataFrame, key: str, n: str) -> list:
    """The keys with over 1/HOT of all rows (so fewer than HOT), from a table of keys and their counts."""
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return [r[0] for r in counted.filter((F.col(n) * HOT > total) & (F.col(n) > 1000) & F.col(key).isNotNull()).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """left and right (one row a key) joined on key; left rows of the hot keys are dealt to SPREAD places."""
    if not hot:
        return left.join(right, key)
    heavy = F.col(key).isin(hot)
    zero, last = (F.lit(i).cast("long") for i in (0, SPREAD - 1))
    left = left.withColumn("_place", F.when(heavy, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(zero))
    right = right.withColumn("_place", F.explode(F.when(heavy, F.sequence(zero, last)).otherwise(F.array(zero))))
    return left.join(right, [key, "_place"]).drop("_place")
