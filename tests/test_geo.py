import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.functions import geo, parse, units


def values(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


PLACES = st.lists(st.tuples(st.floats(-80, 80), st.floats(-179, 179)), min_size=2, max_size=20)


@settings(max_examples=6, deadline=None)
@given(PLACES)
def test_distance_is_symmetric_and_right(spark, places):
    rows = [(*a, *b, metres(a, b)) for a, b in zip(places, places[1:], strict=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    there, back = (geo.distance_m(*[F.col(x) for x in order]) for order in ("abcd", "cdab"))
    for r in df.select(there.alias("there"), back.alias("back"), "want").collect():
        assert math.isclose(r.there, r.back, abs_tol=1e-6) and math.isclose(r.there, r.want, rel_tol=1e-9, abs_tol=1e-3)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.floats(0.001, 89), st.floats(0.001, 179)), min_size=1, max_size=20))
def test_cell_bounds_hold_the_point(spark, places):
    df = spark.createDataFrame(places, "lat double, lng double")
    b = geo.cell_bounds(geo.cell_id(F.col("lat"), F.col("lng")))
    for r in df.select("lat", "lng", b.alias("b")).collect():
        assert r.b.south <= r.lat + 1e-9 and r.lat <= r.b.north + 1e-9 and r.b.west <= r.lng + 1e-9 and r.lng <= r.b.east + 1e-9


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.floats(-70, 70), st.floats(-170, 170), st.floats(1, 5000), st.floats(-179, 179)), min_size=1, max_size=20))
def test_destination_is_that_far_that_way(spark, moves):
    df = spark.createDataFrame(moves, "lat double, lng double, m double, deg double")
    to = df.withColumn("to", geo.destination(F.col("lat"), F.col("lng"), F.col("m"), F.col("deg")))
    far, way = geo.distance_m(F.col("lat"), F.col("lng"), F.col("to.lat"), F.col("to.lng")), geo.bearing_deg(F.col("lat"), F.col("lng"), F.col("to.lat"), F.col("to.lng"))
    for r in to.select("m", "deg", far.alias("far"), way.alias("way")).collect():
        assert math.isclose(r.far, r.m, rel_tol=1e-5, abs_tol=1e-3)
        assert abs((r.way - r.deg + 180) % 360 - 180) < 0.1


def test_cells(spark):
    lit = lambda a, b: (F.lit(a).cast("double"), F.lit(b).cast("double"))
    got = values(spark, geo.cell_id(*lit(-0.0005, 1.9999)), geo.cell_id(*lit(-0.0005, 1.9999), floor=True), geo.cell_id(*lit(None, 1.0)), geo.neighbour_cells(*lit(None, 1.0)), geo.neighbour_cells(*lit(37.5005, 127.0005)))
    assert got[:4] == ("0_1999", "-1_1999", None, None)
    assert len(set(got[4])) == 9 and "37500_127000" in got[4] and "37499_127001" in got[4]


def test_nulls_in_distance_and_bearing(spark):
    n, one = F.lit(None).cast("double"), F.lit(1.0)
    got = values(spark, geo.distance_m(one, n, one, one), geo.distance_m(one, n, one, one, on_null=0.0), geo.bearing_deg(n, one, one, one, on_null=0.0))
    assert tuple(got) == (None, 0.0, 0.0)


def test_mean_time_is_of_whole_seconds(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    got = values(spark, geo.mean_time(t("2024-01-01 00:00:01.900"), t("2024-01-01 00:00:02.100")).cast("string"))
    assert got[0] == "2024-01-01 00:00:01.5"


@pytest.mark.parametrize(("done", "state", "want"), [(True, "running", "completed"), (False, "running", "moving"), (False, "paused", "paused"), (False, None, "waiting")])
def test_status(spark, done, state, want):
    assert values(spark, units.status(F.lit(done), F.lit(state)))[0] == want


def test_units(spark):
    got = values(spark, units.kmh(F.lit(10.0)), units.mps(F.lit(36.0)), units.km(F.lit(1250.0)), units.progress_percent(F.lit(500.0), F.lit(400.0)), units.progress_percent(F.lit(1.0), F.lit(0.0)), F.round(units.progress_percent(F.lit(1.0), F.lit(3.0)), 1))
    assert tuple(got) == (36.0, 10.0, 1.25, 100.0, 0.0, 33.3)


def test_parsing_with_defaults(spark):
    v = F.lit('{"n": 3, "m": -3, "x": "abc", "p": {"q": 1.5}}')
    got = values(spark, parse.json_count(v, "$.n"), parse.json_count(v, "$.m"), parse.json_count(v, "$.x"), parse.json_double(v, "$.p.q"), parse.json_double(v, "$.none"), parse.json_string(v, "$.none"), parse.event_time(F.lit("nonsense")), parse.pattern_time(F.lit("2008/01/02 03:04:05"), "yyyy/MM/dd HH:mm:ss").cast("string"), parse.pattern_time(F.lit("x"), "yyyy"))
    assert tuple(got) == (3, 0, 0, 1.5, 0.0, "", None, "2008-01-02 03:04:05", None)
