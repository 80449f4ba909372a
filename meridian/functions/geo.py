"""Geometry on the sphere and on a grid of thousandths of a degree, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
CELLS_PER_DEGREE = 1000


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, on_null: float | None = None) -> Column:
    """Great-circle distance in metres; ``on_null`` (else null) where a coordinate is missing."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), F.lit(2.0))
    found = F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return found if on_null is None else F.coalesce(found, F.lit(on_null))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column, on_null: float | None = None) -> Column:
    """Initial bearing from the first point to the second, in (-180, 180] degrees."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lng2) - F.radians(lng1)
    found = F.degrees(F.atan2(F.sin(turn) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)))
    return found if on_null is None else F.coalesce(found, F.lit(on_null))


def destination(lat: Column, lng: Column, metres: Column, bearing: Column) -> Column:
    """struct<lng, lat> reached from a point over a distance along an initial bearing."""
    a, along, turn = F.radians(lat), metres / F.lit(EARTH_RADIUS_M), F.radians(bearing)
    b = F.asin(F.sin(a) * F.cos(along) + F.cos(a) * F.sin(along) * F.cos(turn))
    east = F.atan2(F.sin(turn) * F.sin(along) * F.cos(a), F.cos(along) - F.sin(a) * F.sin(b))
    return F.struct(F.degrees(F.radians(lng) + east).alias("lng"), F.degrees(b).alias("lat"))


def cell_index(degrees: Column, floor: bool = False) -> Column:
    """Grid index of a coordinate; towards zero (so cells at 0 are twice as wide), or down with ``floor``."""
    scaled = degrees * CELLS_PER_DEGREE
    return (F.floor(scaled) if floor else scaled).cast("int")


def cell_name(lat_index: Column, lng_index: Column) -> Column:
    """``<lat>_<lng>``; null if either index is."""
    return F.concat(lat_index.cast("string"), F.lit("_"), lng_index.cast("string"))


def cell_id(lat: Column, lng: Column, floor: bool = False) -> Column:
    return cell_name(cell_index(lat, floor), cell_index(lng, floor))


def neighbour_cells(lat: Column, lng: Column, floor: bool = False) -> Column:
    """The names of the 3 x 3 cells around a point, its own included; null without a point."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    row, column = cell_index(lat, floor), cell_index(lng, floor)
    cells = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: cell_name(row + i, column + j))))
    return F.when(row.isNotNull() & column.isNotNull(), cells)


def cell_bounds(cell: Column) -> Column:
    """struct<south, west, north, east> of a cell by its name (for positive coordinates)."""
    parts = F.split(cell, "_")
    row, column = F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")
    edge = lambda index: index / F.lit(float(CELLS_PER_DEGREE))
    return F.struct(edge(row).alias("south"), edge(column).alias("west"), edge(row + 1).alias("north"), edge(column + 1).alias("east"))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation from a (t = 0) to b (t = 1)."""
    return a + (b - a) * t


def mean_position(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """struct<lat, lng> half way between two points, coordinate by coordinate."""
    return F.struct(((lat1 + lat2) / 2).alias("lat"), ((lng1 + lng2) / 2).alias("lng"))


def mean_time(a: Column, b: Column) -> Column:
    """The time half way between two, both cut to whole seconds first."""
    return ((a.cast("long") + b.cast("long")) / 2).cast("timestamp")
