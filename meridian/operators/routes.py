"""Positions on routes; a route is an array of struct<lng, lat>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

PLACE = "struct<lng: double, lat: double>"


def _legs(waypoints: Column) -> Column:
    """Indices of the segments' first points (none for fewer than two points)."""
    return F.when(F.size(waypoints) > 1, F.sequence(F.lit(0), F.size(waypoints) - 2)).otherwise(F.array().cast("array<int>"))


def _leg_m(waypoints: Column, i: Column) -> Column:
    a, b = F.get(waypoints, i), F.get(waypoints, i + 1)
    return geo.distance_m(a["lat"], a["lng"], b["lat"], b["lng"])


def length_m(waypoints: Column) -> Column:
    """Sum of the segments' lengths in metres."""
    return F.aggregate(_legs(waypoints), F.lit(0.0), lambda total, i: total + _leg_m(waypoints, i))


def position_at(waypoints: Column, length: Column, progress: Column) -> Column:
    """Place after a share of the route's length; its ends for a share outside 0..1."""
    target = length * progress

    def step(s: Column, i: Column) -> Column:
        a, b, leg = F.get(waypoints, i), F.get(waypoints, i + 1), _leg_m(waypoints, i)
        t = F.when(leg > 0, (target - s["covered"]) / leg).otherwise(0.0)
        here = F.struct(geo.lerp(a["lng"], b["lng"], t).alias("lng"), geo.lerp(a["lat"], b["lat"], t).alias("lat"))
        found = F.when(s["found"].isNotNull(), s["found"]).when(s["covered"] + leg >= target, here)
        return F.struct((s["covered"] + leg).alias("covered"), found.alias("found"))

    zero = F.struct(F.lit(0.0).alias("covered"), F.lit(None).cast(PLACE).alias("found"))
    last = F.get(waypoints, F.size(waypoints) - 1)
    inside = F.coalesce(F.aggregate(_legs(waypoints), zero, step)["found"], last)
    return F.when(progress >= 1, last).when(progress <= 0, F.get(waypoints, F.lit(0))).otherwise(inside)


def resample(routes: DataFrame, waypoints: str = "waypoints", steps: int = 100) -> DataFrame:
    """steps + 1 evenly spaced places on each route: the other columns, step, lng, lat."""
    rest = [c for c in routes.columns if c != waypoints]
    measured = routes.withColumn("_m", length_m(F.col(waypoints))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    placed = measured.withColumn("_p", position_at(F.col(waypoints), F.col("_m"), F.col("step") / steps))
    return placed.select(*rest, "step", "_p.lng", "_p.lat")


def advance(routes: DataFrame, speed: Column, seconds: Column, waypoints: str = "waypoints") -> DataFrame:
    """routes with travelled (m), progress (0..1), lng, lat and completed after some seconds at a speed."""
    rest = [c for c in routes.columns if c != waypoints]
    moved = routes.withColumn("_m", length_m(F.col(waypoints))).withColumn("travelled", speed * seconds)
    moved = moved.withColumn("progress", F.when(F.col("_m") > 0, F.least(F.col("travelled") / F.col("_m"), F.lit(1.0))).otherwise(1.0))
    moved = moved.withColumn("_p", position_at(F.col(waypoints), F.col("_m"), F.col("progress")))
    return moved.select(*rest, "travelled", "progress", "_p.lng", "_p.lat", (F.col("progress") >= 1).alias("completed"))


def meeting_speed(metres_a: Column, speed_a: Column, metres_b: Column) -> Column:
    """Speed at which b covers its way to a crossing in the time that a needs for its own; null if a needs none."""
    return F.try_divide(metres_b, F.try_divide(metres_a, speed_a))
