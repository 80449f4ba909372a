"""Units, progress and status of a moving object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kmh(metres_per_second: Column) -> Column:
    return F.round(metres_per_second * 3.6, 2)


def mps(kilometres_per_hour: Column) -> Column:
    return kilometres_per_hour * 1000 / 3600


def km(metres: Column) -> Column:
    return F.round(metres / 1000, 2)


def progress_percent(travelled: Column, total: Column) -> Column:
    """Share of a route that is done, one decimal, at most 100; 0 for a route without length."""
    return F.when(total > 0, F.least(F.lit(100.0), F.round(travelled / total * 100, 1))).otherwise(F.lit(0.0))


def status(completed: Column, state: Column) -> Column:
    """completed, or by the state of the run: moving, paused, else waiting."""
    return F.when(completed, "completed").when(state == "running", "moving").when(state == "paused", "paused").otherwise("waiting")
