"""Tables derived from ``events``, which holds no places: pings, routes, intervals, messages.

Only + - * / and integer division, so every engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

LAT = "37.485D + 0.0027D * (user_id % 12) + ((event_id * 7919) % 1201 - 600) / 1000000D"
LNG = "126.985D + 0.0043D * (user_id % 12) + ((event_id * 104729) % 1501 - 750) / 1000000D"
PINGS_SQL = """pings as (
  select 'user-' || user_id as id, user_id, event_id, event_type,
    timestamp '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // {k}) as event_time,
    37.485::double + 0.0027::double * (user_id % 12) + ((event_id * 7919) % 1201 - 600) / 1000000.0::double as lat,
    126.985::double + 0.0043::double * (user_id % 12) + ((event_id * 104729) % 1501 - 750) / 1000000.0::double as lng
  from events
)"""
#: time is divided by these for encounters and for windows of motion
NEAR, MOTION = 600, 6000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with UTC timestamps (times are UTC at rest, so the session is set to it)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def as_pings(rows: DataFrame, k: int = 1) -> DataFrame:
    """id, user_id, event_id, event_type, event_time, lat, lng; time runs k times faster."""
    start = "unix_micros(timestamp '2024-01-01 00:00:00')"
    time = F.expr(f"timestamp_micros({start} + (unix_micros(ts) - {start}) div {k})")
    named = F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id")
    return rows.select(named, "user_id", "event_id", "event_type", time.alias("event_time"), F.expr(LAT).alias("lat"), F.expr(LNG).alias("lng"))


def pings(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    return as_pings(events(spark, sf_dir), k)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings of the motion time scale by user."""
    return pings(spark, sf_dir, MOTION).select(F.col("id").alias("user_id"), "event_time", "event_id", "lat", "lng", "event_type")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, waypoints): two legs of 300 and 500 m through each user's hub."""
    users = events(spark, sf_dir).select("user_id").distinct()
    lat, lng = F.expr("37.485D + 0.0027D * (user_id % 12)"), F.expr("126.985D + 0.0043D * (user_id % 12)")
    bearing = F.expr("cast((user_id * 37) % 360 as double)")
    way = F.array(geo.destination(lat, lng, F.lit(300.0), bearing + 180), F.struct(lng.alias("lng"), lat.alias("lat")), geo.destination(lat, lng, F.lit(500.0), bearing))
    return users.select("user_id", way.alias("waypoints"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, start_time, end_time, label): every tenth point of a user begins an interval."""
    return spark.sql(
        """select user_id, event_time as start_time, end_time, label from (
             select *, lead(event_time) over (partition by user_id order by event_time, event_id) as end_time from (
               select *, row_number() over (partition by user_id order by event_time, event_id) as rn,
                 decode(event_type, 'click', 'walk', 'view', 'bus', 'purchase', 'bike', 'signup', 'car', 'boat') as label from {points})
             where rn % 10 = 1) where end_time is not null""",
        points=points(spark, sf_dir),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, time, mode): a prediction for each event; times are made distinct by the event's number."""
    mode = F.expr("decode(event_type, 'click', 'walk', 'purchase', 'bike', 'transport')")
    return points(spark, sf_dir).select("user_id", F.struct("event_time", "event_id").alias("time"), mode.alias("mode"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, sent_as, value): pings as JSON; some are cut short, lack a place or a time, or are sent under another id."""
    rows = pings(spark, sf_dir).withColumn("iso", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    time = F.when(F.col("event_id") % 11 == 3, "not a time").otherwise(F.col("iso"))
    place = F.when(F.col("event_id") % 13 != 5, F.struct("lat", "lng"))
    speed = F.when(F.col("event_id") % 3 == 0, F.expr("(event_id % 40) / 4D"))
    value = F.to_json(F.struct("id", F.concat(F.lit("route-"), F.col("user_id") % 5).alias("route_id"), time.alias("timestamp"), place.alias("position"), speed.alias("speed_mps")))
    cut = F.when(F.col("event_id") % 7 == 1, F.substring(value, 1, 20)).otherwise(value)
    return rows.select("event_id", F.when(F.col("event_id") % 17 == 2, "nobody").otherwise(F.col("id")).alias("sent_as"), cut.alias("value"))
