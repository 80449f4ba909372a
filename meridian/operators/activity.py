"""Timelines of predicted modes: smoothing, changes, shares.

``period`` is a column that doesn't fall as a user's time goes on, such as the day. A user's
period is the unit of work, so that a user with very many predictions is spread over periods;
from one to the next only what is at their edges is passed on, shuffled by user.
Results don't depend on it; without it a user is one unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IN_A_ROW = 3
MOTORISED = "transport"
UNIT = ["user_id", "_period"]


def _with_neighbours(rows: DataFrame, time: str) -> DataFrame:
    """rows with ``_before`` and ``_after``: structs with the mode of the user's row before and after (null: none).

    Neighbours inside a period are found there; only a period's first and last rows go on to
    the user's window.
    """
    one, unit, user = F.struct("mode"), Window.partitionBy(*UNIT).orderBy(time), Window.partitionBy("user_id").orderBy("_period", time)
    marked = rows.withColumns({"_before": F.lag(one).over(unit), "_after": F.lead(one).over(unit)})
    at_edge = F.col("_before").isNull() | F.col("_after").isNull()
    found = {"_before": F.coalesce("_before", F.lag(one).over(user)), "_after": F.coalesce("_after", F.lead(one).over(user))}
    return marked.filter(~at_edge).unionByName(marked.filter(at_edge).withColumns(found))


def _dealt(timeline: DataFrame, period: Column | None) -> DataFrame:
    return timeline.withColumn("_period", F.lit(0) if period is None else period)


def smooth(timeline: DataFrame, period: Column | None = None) -> DataFrame:
    """timeline (user_id, time, mode) with a mode that differs from two equal neighbours set to theirs."""
    before, after = F.col("_before.mode"), F.col("_after.mode")
    mode = F.when((before == after) & (before != F.col("mode")), before).otherwise(F.col("mode"))
    return _with_neighbours(_dealt(timeline, period), "time").withColumn("mode", mode).select(*timeline.columns)


def islands(timeline: DataFrame, period: Column | None = None) -> DataFrame:
    """(user_id, mode, start, confirmed, end, n): runs of equal modes; confirmed is the time of the IN_A_ROWth."""
    return _islands(_dealt(timeline, period)).drop("_period")


def _islands(dealt: DataFrame) -> DataFrame:
    by_time = Window.partitionBy(*UNIT).orderBy("time")
    new = F.when(F.col("mode") == F.lag("mode").over(by_time), 0).otherwise(1)
    runs = dealt.withColumn("new", new).withColumn("run", F.sum("new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumns({"k": F.row_number().over(Window.partitionBy(*UNIT, "run").orderBy("time")), "runs": F.max("run").over(Window.partitionBy(*UNIT))})
    head = F.sort_array(F.collect_list(F.when(F.col("k") <= IN_A_ROW, F.col("time"))))
    runs = runs.groupBy(*UNIT, "run", "runs", "mode").agg(F.min("time").alias("start"), head.alias("head"), F.max("time").alias("end"), F.count(F.lit(1)).alias("n"))
    at_edge = (F.col("run") == 1) | (F.col("run") == F.col("runs"))
    # a period's first run may go on from the last run of the period before
    periods = Window.partitionBy("user_id").orderBy("_period", "run")
    goes_on = (F.col("mode") == F.lag("mode").over(periods)) & (F.col("_period") != F.lag("_period").over(periods))
    chain = F.sum(F.when(goes_on, 0).otherwise(1)).over(periods.rowsBetween(Window.unboundedPreceding, 0))
    first = F.slice(F.sort_array(F.flatten(F.collect_list("head"))), 1, IN_A_ROW)
    whole = runs.filter(at_edge).withColumn("chain", chain).groupBy("user_id", "chain", "mode").agg(
        F.min("_period").alias("_period"), F.min("start").alias("start"), first.alias("head"), F.max("end").alias("end"), F.sum("n").alias("n"),
    )
    columns = ["user_id", "_period", "mode", "start", F.get("head", F.lit(IN_A_ROW - 1)).alias("confirmed"), "end", "n"]
    return whole.select(*columns).union(runs.filter(~at_edge).select(*columns))


def changes(timeline: DataFrame, period: Column | None = None) -> DataFrame:
    """(user_id, time, from_mode, to_mode, alert): a mode other than the last confirmed one, IN_A_ROW times in a row.

    alert: the change is to motorised travel.
    """
    sure = _islands(_dealt(timeline, period)).filter("confirmed is not null")
    moved = _with_neighbours(sure, "start").filter("_before.mode <> mode")
    return moved.select("user_id", F.col("confirmed").alias("time"), F.col("_before.mode").alias("from_mode"), F.col("mode").alias("to_mode"), (F.col("mode") == MOTORISED).alias("alert"))


def shares(timeline: DataFrame) -> DataFrame:
    """(user_id, mode, n, share): each mode's part of a user's predictions."""
    counts = timeline.groupBy("user_id", "mode").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return counts.withColumn("share", F.col("n") / total)
