"""Motion between consecutive points of a user, and one point a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

POINT = ["event_time", "tie", "lat", "lng"]
#: jerk looks back over three points
LOOK_BACK = 3


def _with_earlier(points: DataFrame) -> DataFrame:
    """points by (user_id, day), each day with the user's last points before it (``own`` false).

    A user's day is the unit of the later window, so that a user with very many points is
    spread over days. Only the last points of each day are shuffled by user.
    """
    dayed = points.withColumn("day", F.to_date("event_time"))
    last = Window.partitionBy("user_id", "day").orderBy(F.desc("event_time"), F.desc("tie"))
    ends = dayed.withColumn("rn", F.row_number().over(last)).filter(F.col("rn") <= LOOK_BACK)
    tails = ends.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct(*POINT))).alias("tail"))
    before = Window.partitionBy("user_id").orderBy("day")
    earlier = F.flatten(F.array(*[F.coalesce(F.lag("tail", k).over(before), F.array().cast(tails.schema["tail"].dataType)) for k in range(LOOK_BACK, 0, -1)]))
    ghosts = tails.withColumn("earlier", earlier).select("user_id", "day", F.explode(F.slice(F.reverse("earlier"), 1, LOOK_BACK)).alias("p"))
    return dayed.select("user_id", "day", *POINT, F.lit(True).alias("own")).unionByName(ghosts.select("user_id", "day", "p.*", F.lit(False).alias("own")))


def kinematics(points: DataFrame, tie: str | None = None, wrap: bool = False) -> DataFrame:
    """user_id, event_time, lat, lng, distance, speed, accel, jerk, bearing, bearing_rate of each point.

    Each is taken against the user's point before (by time, then the ``tie`` column):
    metres, m/s, m/s2, m/s3, degrees and degrees a second, over whole seconds. Speed and
    its changes are 0 where no time passed; distance and bearing are 0 for a first point;
    bearing_rate is null where it can't be had. ``wrap`` takes turns the short way round.
    """
    base = points.select("user_id", "event_time", "lat", "lng", (F.col(tie) if tie else F.lit(0)).alias("tie"))
    w = Window.partitionBy("user_id", "day").orderBy("event_time", "tie")
    seconds = F.col("event_time").cast("long") - F.lag("event_time").over(w).cast("long")
    before = F.lag("lat").over(w), F.lag("lng").over(w)

    def per_second(change: Column) -> Column:
        return F.when(F.col("dt") > 0, change / F.col("dt")).otherwise(0.0)

    here = F.col("lat"), F.col("lng")
    moved = {"distance": geo.distance_m(*here, *before, on_null=0.0), "bearing": geo.bearing_deg(*before, *here, on_null=0.0)}
    step = _with_earlier(base).withColumns({"dt": seconds, **moved})
    step = step.withColumn("speed", per_second(F.col("distance")))
    step = step.withColumn("accel", per_second(F.col("speed") - F.lag("speed").over(w)))
    turn = F.col("bearing") - F.lag("bearing").over(w)
    if wrap:
        turn = F.pmod(turn + 180, F.lit(360.0)) - 180
    step = step.withColumns({"jerk": per_second(F.col("accel") - F.lag("accel").over(w)), "bearing_rate": F.try_divide(turn, F.col("dt"))})
    return step.filter("own").select("user_id", "event_time", "lat", "lng", "distance", "speed", "accel", "jerk", "bearing", "bearing_rate")


def one_per_second(pings: DataFrame, tie: str) -> DataFrame:
    """The first ping of each id and second (ties by a column)."""
    rest = [c for c in pings.columns if c not in ("id", "event_time", tie)]
    first = F.min(F.struct("event_time", tie, *rest)).alias("p")
    return pings.groupBy("id", F.date_trunc("second", "event_time").alias("second")).agg(first).select("id", "p.*")
