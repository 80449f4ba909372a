"""Motion features over sliding windows, and labels from intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

WINDOW_S, SLIDE_S = 60, 30
STOP_BELOW, SHARP_TURN = 0.5, 15
# Names and order of the features, as saved models expect them.
FEATURES = (
    "avg_speed", "max_speed", "stddev_speed", "p75_speed", "p95_speed", "avg_accel", "max_accel", "stddev_accel", "avg_jerk", "max_jerk", "stddev_jerk",
    "stop_rate", "avg_bearing_rate", "stddev_bearing_rate", "hcr_rate", "total_distance", "straightness_index",
)


def _sample_quantile(q: float):
    return lambda c: F.percentile_approx(c, q)


#: statistics of a window by the prefix of their names
STATISTICS = {"avg": F.avg, "max": F.max, "stddev": F.stddev, "p75": _sample_quantile(0.75), "p95": _sample_quantile(0.95)}
#: which statistics of which motion value are features
MEASURED = {"speed": ("avg", "max", "stddev", "p75", "p95"), "accel": ("avg", "max", "stddev"), "jerk": ("avg", "max", "stddev"), "bearing_rate": ("avg", "stddev")}


def window_features(motion: DataFrame) -> DataFrame:
    """user_id, window and the FEATURES of each user and sliding window that has points.

    Points with a missing motion value are left out; a deviation of one point is 0. One
    grouping serves statistics and end points. Straightness is the straight line from
    first to last point over the distance travelled, 1 without any.
    """
    known = motion.na.drop(subset=[*MEASURED, "distance"])
    place = F.struct("event_time", "lat", "lng")

    def share(condition) -> object:
        return F.count(F.when(condition, 1)) / F.count(F.lit(1))

    measured = [STATISTICS[s](c).alias(f"{s}_{c}") for c, names in MEASURED.items() for s in names]
    window = F.window("event_time", f"{WINDOW_S} seconds", f"{SLIDE_S} seconds").alias("window")
    grouped = known.groupBy("user_id", window).agg(
        *measured, share(F.col("speed") < STOP_BELOW).alias("stop_rate"), share(F.abs("bearing_rate") > SHARP_TURN).alias("hcr_rate"),
        F.sum("distance").alias("total_distance"), F.min(place).alias("first"), F.max(place).alias("last"),
    ).na.fill(0)
    line = geo.distance_m(F.col("first.lat"), F.col("first.lng"), F.col("last.lat"), F.col("last.lng"), on_null=0.0)
    straight = F.when(F.col("total_distance") > 0, line / F.col("total_distance")).otherwise(1.0)
    return grouped.withColumn("straightness_index", straight).select("user_id", "window", *FEATURES)


# Labels that aren't taken for transport, by their group; None: left out.
GROUPS = {"walk": "walk", "run": "walk", "bike": "bike", "motorcycle": "bike", "boat": None, "airplane": None}


def regroup(intervals: DataFrame, groups: dict[str, str | None] = GROUPS, rest: str = "transport") -> DataFrame:
    """Labels in groups (walk, bike, transport); those without a group are left out."""
    dropped = [label for label, group in groups.items() if group is None]
    mapped = F.create_map(*[F.lit(x) for label, group in groups.items() if group for x in (label, group)])
    return intervals.filter(~F.col("label").isin(dropped)).withColumn("label", F.coalesce(F.try_element_at(mapped, F.col("label")), F.lit(rest)))


def stretches(first: Column, last: Column) -> Column:
    """array<struct<level, node>>: aligned stretches of 2^level units that together are first to last.

    At most two of each level, so about twice the logarithm of how many units there are.
    """
    begin = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(last - first, F.lit(0)).cast("double") + 1)).cast("int") + 1)

    def step(s: Column, level: Column) -> Column:
        odd = (s["a"] <= s["b"]) & (F.pmod(s["a"], F.lit(2)) == 1)
        even = (s["a"] <= s["b"]) & (F.pmod(s["b"], F.lit(2)) == 0) & ~(odd & (s["a"] == s["b"]))
        taken = [F.when(c, F.array(F.struct(level.alias("level"), s[x].alias("node")))) for c, x in ((odd, "a"), (even, "b"))]
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        out = F.concat(s["out"], *[F.coalesce(t, none) for t in taken])
        a, b = s["a"] + F.when(odd, 1).otherwise(0), s["b"] - F.when(even, 1).otherwise(0)
        done = s["a"] > s["b"]
        # an empty rest stays empty
        ends = [F.when(done | (a > b), F.lit(empty)).otherwise(F.shiftright(x, 1)).cast("long").alias(name) for x, empty, name in ((a, 1, "a"), (b, 0, "b"))]
        return F.struct(*ends, out.alias("out"))

    return F.aggregate(levels, begin, step, lambda s: s["out"])


def label_windows(features: DataFrame, intervals: DataFrame, unit_s: int = 600) -> DataFrame:
    """features with the label of each interval of the user that holds the window's centre.

    Both ends count as inside; overlapping intervals give a row each. Time is cut in units,
    and these are joined to larger and larger aligned stretches. An interval is filed under
    the few stretches that make it up (however long it lasts), a window under the stretches
    that hold its unit, of the levels that intervals use. So the join's keys are whole
    numbers, and a user with very many windows and intervals is divided by time.
    """
    center = (F.col("window.start").cast("long") + F.col("window.end").cast("long")) / 2
    filed = intervals.filter("start_time <= end_time").select(
        F.col("user_id").alias("labelled"), "start_time", "end_time", "label",
        F.explode(stretches(F.floor(F.col("start_time").cast("long") / unit_s), F.floor(F.col("end_time").cast("long") / unit_s))).alias("stretch"),
    )
    right = filed.select("labelled", "start_time", "end_time", "label", F.col("stretch.level").alias("of_level"), F.col("stretch.node").alias("of_node"))
    # one row, of at most 64 levels
    used = F.broadcast(right.agg(F.collect_set("of_level").alias("levels")))
    left = features.withColumn("center", center.cast("timestamp")).withColumn("unit", F.floor(center / unit_s)).crossJoin(used)
    left = left.withColumn("level", F.explode("levels")).withColumn("node", F.expr("shiftright(unit, level)"))
    same = (F.col("user_id") == F.col("labelled")) & (F.col("level") == F.col("of_level")) & (F.col("node") == F.col("of_node"))
    return left.join(right, same & F.col("center").between(F.col("start_time"), F.col("end_time"))).select("user_id", "window", *FEATURES, "label")
