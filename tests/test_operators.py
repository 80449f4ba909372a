import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import activity, components, density, features, kinematics, modes, paths, proximity, routes
from meridian.plans import fixtures
from meridian.sources import pings as wire
from meridian.sources import store, trajectories

from .conftest import MEDIUM, SMALL

T0 = datetime(2024, 1, 1)


def pings(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), lat, lng) for i, s, lat, lng in rows], "id string, event_time timestamp, lat double, lng double")


def test_one_sided_pairs_equal_two_sided(spark):
    p = fixtures.pings(spark, SMALL, 6000)
    both = p.select("id", "event_time", "lat", "lng", F.explode(geo.neighbour_cells(F.col("lat"), F.col("lng"))).alias("cell"))
    a, b = both.alias("a"), both.alias("b")
    near = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") != F.col("b.id")) & (F.abs(F.unix_micros("a.event_time") - F.unix_micros("b.event_time")) <= 5_000_000))
    near = near.filter(geo.distance_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) < 20)
    want = {tuple(r) for r in near.select("a.id", "b.id", "a.event_time", "b.event_time").distinct().collect()}
    got = [tuple(r) for r in proximity.near_pairs(p).select("user1_id", "user2_id", "time1", "time2").collect()]
    assert want and set(got) == want


def test_edges_of_time_cell_and_radius(spark):
    north = 18 / 111194.93
    rows = [("a", 10, 37.5, 127.0), ("b", 15, 37.5 - north, 127.0), ("c", 15.001, 37.5, 127.0), ("d", 5, 37.5 + north, 127.0), ("a", 11, 37.5, 127.0), ("e", None or 10, None, 127.0), (None, 10, 37.5, 127.0), ("f", 9.999, 37.5, 127.0 + 20.1 / 88200)]
    got = {(r.user1_id, r.user2_id) for r in proximity.near_pairs(pings(spark, rows)).collect()}
    assert got == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("a", "d"), ("d", "a"), ("b", "c"), ("c", "b")}
    one = {(r.user1_id, r.user2_id) for r in proximity.near_pairs(pings(spark, rows), canonical=True).collect()}
    assert one == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")}


def test_radius_must_be_sensible():
    for radius in (0, -1, 2_000_000):
        with pytest.raises(ValueError):
            proximity.check_radius(radius)


def test_pairs_at_any_latitude_and_across_the_meridian(spark):
    import math
    import random

    def metres(a, b):
        (p, l), (q, m) = [tuple(map(math.radians, x)) for x in (a, b)]
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((m - l) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    draw, points = random.Random(4), []
    for lat in (0.0, 37.5, -60.0, 85.0, 89.9995, -89.9999):
        for lng in (12.0, 179.9999, -180.0):
            for _ in range(8):
                step = 150 / 111_000
                y = max(-90.0, min(90.0, lat + draw.uniform(-step, step)))
                x = lng + draw.uniform(-step, step) / max(1e-3, math.cos(math.radians(lat)))
                points.append((y, (x + 180) % 360 - 180))
    rows = [(f"u{i}", "2024-01-01 00:00:00", *p) for i, p in enumerate(points)]
    pings = spark.createDataFrame(rows, "id string, t string, lat double, lng double").selectExpr("id", "cast(t as timestamp) as event_time", "lat", "lng")
    for radius in (20.0, 80.0, 110.0, 300.0):
        want = {(f"u{i}", f"u{j}") for i, a in enumerate(points) for j, b in enumerate(points) if i != j and metres(a, b) < radius}
        got = [(r.user1_id, r.user2_id) for r in proximity.near_pairs(pings, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_stadium_is_dealt_to_several_tasks(spark):
    """A crowd in one place and time: same pairs, and no key of the join with over four times the usual rows."""
    crowd = [(f"s{k}", k % 4 + k / 1000, 37.5 + (k % 7) / 1e6, 127.0) for k in range(600)]
    rest = [(f"r{k}", 20 * (k // 40), 37.6 + (k % 40) / 10, 127.0 + k / 50) for k in range(400)]
    p = pings(spark, crowd + rest)
    assert proximity.near_pairs(p, crowd=50).exceptAll(proximity.near_pairs(p, crowd=10**9)).count() == 0
    assert proximity.near_pairs(p, crowd=50).count() == proximity.near_pairs(p, crowd=10**9).count() > 100_000
    _, right = proximity.sides(p, 20.0, 5, 50)
    sizes = [r["count"] for r in right.groupBy(*proximity.KEYS, "part").count().collect()]
    assert max(sizes) <= 4 * 50
    _, whole = proximity.sides(p, 20.0, 5, 10**9)
    assert max(r["count"] for r in whole.groupBy(*proximity.KEYS, "part").count().collect()) > 500


def test_chunks_of_long_groups(spark):
    from meridian.operators import chunks

    pick = random.Random(9)
    rows = [(pick.choice(["a", "a", "a", "b", None]), pick.choice([None, *range(30)]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = chunks.chunked(df, "g", ["o", "v"], F.struct("o", "v"), "items", 64).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for g in ("a", "b", None):
        want = sorted(((o, v) for x, o, v in rows if x == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        parts = sorted((r.part, [tuple(x) for x in r["items"]]) for r in got if r.g == g)
        assert [p for p, _ in parts] == list(range(len(parts))) and all(len(x) == 64 for _, x in parts[:-1])
        assert [x for _, items in parts for x in items] == want


def test_empty_pings(spark):
    none = pings(spark, [])
    assert proximity.near_pairs(none).collect() == []
    assert density.hourly(none).collect() == []
    assert density.congestion(density.hourly(none)).collect() == []


def test_recent_holds_its_limit(spark):
    events = spark.createDataFrame([(f"u{i}", "v", T0 + timedelta(seconds=i % 9), 1.0, 2.0) for i in range(150)] + [("v", "u3", T0 + timedelta(seconds=3), 1.5, 2.5)], "user1_id string, user2_id string, encounter_time timestamp, lat double, lng double")
    assert proximity.without_mirrors(events).count() == 150
    assert proximity.recent(events, 500).count() == 100 and proximity.recent(events, -1).count() == 1
    assert [r.encounter_time.second for r in proximity.recent(events, 3).collect()] == [8, 8, 8]


def test_null_place_is_a_cell_of_its_own(spark):
    got = density.hourly(pings(spark, [("a", 0, None, 1.0), ("b", 1, None, None), ("a", 2, None, 1.0), ("a", 3, 37.5, 127.0)]))
    assert {(r.cell, r.visitors) for r in got.collect()} == {(None, 2), ("37500_127000", 1)}


def test_sketches_of_overlapping_parts_merge_to_the_union(spark):
    p = fixtures.pings(spark, SMALL)
    parts = density.sketches(p.filter("event_id % 3 <> 0")).union(density.sketches(p.filter("event_id % 3 <> 1")))
    exact = {(r.hour, r.cell): r.visitors for r in density.hourly(p).collect()}
    got = {(r.hour, r.cell): r.visitors for r in density.from_sketches(parts).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) <= max(1, 0.05 * exact[k]) for k in exact)


def test_replayed_block_counts_once(spark, tmp_path):
    counts = density.hourly(fixtures.pings(spark, SMALL))
    for _ in range(2):
        store.append_partials(counts, str(tmp_path), "7")
    assert store.merged(store.read(spark, str(tmp_path))).agg(F.sum("visitors")).first()[0] == counts.agg(F.sum("visitors")).first()[0]


def motion_rows(spark, rows):
    return spark.createDataFrame([(u, T0 + timedelta(seconds=s), k, lat, lng) for k, (u, s, lat, lng) in enumerate(rows)], "user_id string, event_time timestamp, event_id long, lat double, lng double")


def test_a_scope_leaves_only_what_is_kept(spark, tmp_path):
    from pathlib import Path

    from meridian.sources import shared

    def there(df):
        return Path(df.inputFiles()[0].removeprefix("file://")).exists()

    with shared.scope(spark) as kept:
        one = shared.stored(spark.range(3), "one")
        kept.append(shared.fresh_path(spark, "two"))
        two = shared.written(one.union(one), kept[0])
        was = one.inputFiles()[0]
    assert two.count() == 6 and there(two) and not Path(was.removeprefix("file://")).exists()
    with pytest.raises(ValueError), shared.scope(spark):
        three = shared.stored(spark.range(3), "three")
        raise ValueError
    assert three.count() == 3  # after a failure nothing is deleted


def test_readers_never_see_half_a_rollup(spark, tmp_path, monkeypatch):
    """A run that dies between its folder and its manifest changes nothing; a second writer's late manifest is refused."""
    path, into = str(tmp_path / "parts"), str(tmp_path / "merged")

    def add(block, days, n):
        rows = [(T0 + timedelta(days=d, hours=h), f"{h}_1", n) for d in days for h in range(3)]
        store.append_partials(spark.createDataFrame(rows, "hour timestamp, cell string, visitors long"), path, block)

    def seen():
        return {(r.hour.day, r.hour.hour): r.visitors for r in store.snapshot(spark, into).collect()}

    assert store.snapshot(spark, into).collect() == []
    add("a", range(3), 1)
    store.compact(spark, path, into)
    first = seen()
    assert len(first) == 9 and set(first.values()) == {1}
    add("b", [1, 5], 10)
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        store.compact(spark, path, into, "b")
    assert seen() == first
    monkeypatch.undo()
    held = store.snapshot(spark, into)  # a reader that began before
    store.compact(spark, path, into, "b")
    assert seen() == first | {(2, h): 11 for h in range(3)} | {(6, h): 10 for h in range(3)}
    assert {r.visitors for r in held.collect()} == {1}
    with pytest.raises(RuntimeError):
        store._publish(spark, into, 2, {})
    store.vacuum(spark, into, keep=1)
    assert len(seen()) == 12 and len([p for p in (tmp_path / "merged").iterdir() if p.name.startswith("merged-")]) == 2


def test_kinematics_across_days_and_equal_times(spark):
    day = 86400
    rows = [("a", day - 20, 1.0, 1.0), ("a", day - 10, 1.0, 1.001), ("a", day + 10, 1.001, 1.001), ("a", day + 10, 1.002, 1.001), ("a", 3 * day, 1.0, 1.0), ("b", 5, 2.0, 2.0)]
    got = {(r.user_id, r.lat, r.lng, r.event_time): r for r in kinematics.kinematics(motion_rows(spark, rows), tie="event_id").collect()}
    assert len(got) == 6
    first, second, third, twin, late, lone = (got[(u, lat, lng, T0 + timedelta(seconds=s))] for u, s, lat, lng in rows)
    assert first.distance == first.speed == first.bearing == 0 and first.bearing_rate is None and lone.distance == 0
    assert second.speed == pytest.approx(11.1178, abs=1e-3) and second.accel == pytest.approx(1.11178, abs=1e-4) and second.bearing == pytest.approx(90, abs=1e-3)
    assert third.distance == pytest.approx(111.195, abs=1e-2) and third.speed == pytest.approx(5.55975, abs=1e-3)
    assert third.accel == pytest.approx((5.55975 - 11.1178) / 20, abs=1e-4) and third.jerk == pytest.approx((third.accel - second.accel) / 20, abs=1e-6)
    assert twin.speed == 0 and twin.accel == 0 and twin.bearing_rate is None and twin.distance > 0
    assert late.accel == pytest.approx(late.speed / (3 * day - day - 10), rel=1e-6)


def test_windows_overlap_by_half(spark):
    motion = kinematics.kinematics(motion_rows(spark, [("a", s, 1.0, 1.0 + s / 1e5) for s in range(0, 95, 5)]), tie="event_id")
    got = features.window_features(motion).orderBy("window").collect()
    assert [(r.window.start - T0).total_seconds() for r in got] == [-30, 0, 30, 60, 90][: len(got)]
    assert all(r.straightness_index <= 1.3 and r.stop_rate == 0 for r in got)
    assert sum(r.total_distance for r in got) == pytest.approx(2 * motion.na.drop().agg(F.sum("distance")).first()[0])


def test_labels_at_both_ends_and_overlaps(spark):
    motion = kinematics.kinematics(motion_rows(spark, [("a", s, 1.0, 1.0 + s / 1e5) for s in range(0, 7400, 10)]), tie="event_id")
    w = features.window_features(motion)
    t = lambda s: T0 + timedelta(seconds=s)
    spans = spark.createDataFrame([("a", t(60), t(120), "walk"), ("a", t(120), t(120), "run"), ("a", t(90), t(60), "bus"), ("b", t(0), t(900), "bus"), ("a", t(0), t(90), "boat"), ("a", t(3500), t(7300), "motorcycle")], "user_id string, start_time timestamp, end_time timestamp, label string")
    got = sorted(((r.window.start - T0).total_seconds() + 30, r.label) for r in features.label_windows(w, features.regroup(spans)).collect())
    assert [g for g in got if g[0] < 3000] == [(60, "walk"), (90, "walk"), (120, "walk"), (120, "walk")]
    assert [g for g in got if g[0] > 3000] == [(s, "bike") for s in range(3510, 7301, 30)]


def test_stretches_make_up_their_interval(spark):
    pick = random.Random(2)
    ends = [(a, a + pick.choice([0, 1, 2, 7, 8, 63, 1000, 10**9])) for a in [-9, -1, 0, 1, 5, 2**40] + [pick.randrange(-1000, 1000) for _ in range(60)]]
    df = spark.createDataFrame(ends, "a long, b long").select("a", "b", features.stretches(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        parts = sorted((x.node << x.level, (x.node + 1) << x.level) for x in r.s)
        assert parts[0][0] == r.a and parts[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (r.b - r.a + 1).bit_length()


def test_labels_against_every_pair(spark):
    """Nested, touching and very long intervals, and some that end before they begin."""
    pick = random.Random(4)
    spans = [(f"u{pick.randrange(3)}", T0 + timedelta(seconds=(a := pick.randrange(0, 9000, 15))), T0 + timedelta(seconds=a + pick.choice([0, 15, 30, 600, 7200, -30])), pick.choice(["walk", "run", "bus", "boat"])) for _ in range(150)]
    spans += [("u0", T0, datetime(9999, 12, 31), "car"), ("u1", T0 + timedelta(seconds=600), T0 + timedelta(seconds=1200), "bike"), ("u1", T0 + timedelta(seconds=1200), T0 + timedelta(seconds=1800), "bike")]
    df = spark.createDataFrame(spans, "user_id string, start_time timestamp, end_time timestamp, label string")
    windows = [(f"u{u}", {"start": T0 + timedelta(seconds=s - 30), "end": T0 + timedelta(seconds=s + 30)}, *[0.0] * len(features.FEATURES)) for u in range(4) for s in range(0, 16000, 15)]
    w = spark.createDataFrame(windows, "user_id string, window struct<start: timestamp, end: timestamp>, " + ", ".join(f"{c} double" for c in features.FEATURES))
    got = sorted((r.user_id, r.window.start + timedelta(seconds=30), r.label) for r in features.label_windows(w, df, 60).collect())
    want = sorted((u, x["start"] + timedelta(seconds=30), label) for u, x, *_ in windows for v, a, b, label in spans if u == v and a <= x["start"] + timedelta(seconds=30) <= b)
    assert got == want
    long = df.filter("label = 'car'").select(F.size(features.stretches(F.floor(F.unix_timestamp("start_time") / 60), F.floor(F.unix_timestamp("end_time") / 60))).alias("n")).first()
    assert long.n < 100


def test_routes(spark):
    def place(waypoints, progress):
        w = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in waypoints])
        r = spark.range(1).select(routes.position_at(w, routes.length_m(w), F.lit(float(progress))).alias("p"), routes.length_m(w).alias("m")).first()
        return (r.p.lng, r.p.lat), r.m

    line = [(0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (0.0, 3.0)]
    assert place(line, 0)[0] == (0.0, 0.0) and place(line, 2)[0] == (0.0, 3.0) and place(line, -1)[0] == (0.0, 0.0)
    assert place(line, 0.5)[0][1] == pytest.approx(1.5) and place(line, 0.2)[0][1] == pytest.approx(0.6)
    assert place([(5.0, 6.0)], 0.5) == ((5.0, 6.0), 0.0)
    moved = routes.advance(fixtures.routes(spark, SMALL), F.lit(10.0), F.lit(81)).collect()
    assert all(r.completed and r.progress == 1 for r in moved)
    ends = routes.resample(fixtures.routes(spark, SMALL)).filter("step in (0, 100)").join(fixtures.routes(spark, SMALL), "user_id").collect()
    assert all((r.lng, r.lat) == tuple(r.waypoints[0 if r.step == 0 else 2]) for r in ends)


def test_planned_meeting_gives_an_encounter(spark):
    """Two routes through one crossing, the second's speed set so that both reach it together."""
    plan = spark.createDataFrame([("a", 40.0, 300.0, 5.0), ("b", 130.0, 420.0, None)], "id string, deg double, m double, speed double")
    lat, lng = F.lit(37.5), F.lit(127.0)
    way = F.array(geo.destination(lat, lng, F.col("m"), F.col("deg") + 180), F.struct(lng.alias("lng"), lat.alias("lat")), geo.destination(lat, lng, F.lit(200.0), F.col("deg")))
    speed = F.coalesce("speed", routes.meeting_speed(F.lit(300.0), F.lit(5.0), F.col("m")))
    moving = plan.withColumn("speed", speed).withColumn("waypoints", way).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(90))))
    trail = routes.advance(moving, F.col("speed"), F.col("s")).select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("event_time"), "lat", "lng")
    met = proximity.first_of_pair(proximity.encounters(proximity.near_pairs(trail))).collect()
    assert {(r.user1_id, r.user2_id) for r in met} == {("a", "b"), ("b", "a")}
    assert all(abs(r.lat - 37.5) < 3e-4 and abs(r.lng - 127) < 3e-4 for r in met)


def test_frechet(spark):
    def far(a, b):
        path = lambda p: F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in p])
        return spark.range(1).select(paths.frechet_m(path(a), path(b)).alias("m")).first().m

    degree = 111194.93
    line = [(0.0, 0.0), (0.0, 0.001), (0.0, 0.002)]
    assert far(line, line) == 0
    assert far(line, [(0.001, y) for _, y in line]) == pytest.approx(0.001 * degree, rel=1e-4)
    assert far(line, line[::-1]) == pytest.approx(0.002 * degree, rel=1e-4)
    assert far(line, [line[0], line[2]]) == pytest.approx(0.001 * degree, rel=1e-4)


def test_clusters(spark):
    links = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (2, 3, 9.0), (3, 4, 2.0), (10, 11, 1.0)], "a long, b long, metres double")
    every = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 10, 11, 20)], "r long")
    got = {r.r: r.cluster for r in paths.clusters(every, links, "r", 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: None, 11: None, 20: None}
    assert [tuple(r) for r in paths.medoids(paths.clusters(every, links, "r", 3), links, "r").collect()] == [(1, 3, 4)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(31)} | {99: 99, 100: 99}


def test_components_keep_one_round(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(components, "fresh_path", lambda spark, label: f"{tmp_path}/{label}-{len(made)}-{made.append(label) or ''}")
    made = []
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert components.components(edges, "a", "b").count() == 31
    assert len(made) > 2 and len(list(tmp_path.iterdir())) == 1


def test_a_centre_with_most_edges(spark, monkeypatch):
    """Stars with very many edges, chains and a tail of each, dealt out or not."""
    rows = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5040)] + [(2999, 5000), (9001, 9000), (9002, 9001)]
    edges = spark.createDataFrame(rows, "a long, b long")
    monkeypatch.setattr(components, "SMALL", 0)
    got = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    assert got == {n: 9000 if n >= 9000 else 0 for row in rows for n in row}


def test_activity(spark):
    line = spark.createDataFrame([("u", k, m) for k, m in enumerate("wwwtwwtttwb")], "user_id string, time int, mode string")
    assert "".join(r.mode for r in activity.smooth(line).orderBy("time").collect()) == "wwwwwwtttwb"
    named = line.replace({"w": "walk", "t": "transport", "b": "bike"})
    assert [tuple(r) for r in activity.changes(named).collect()] == [("u", 8, "walk", "transport", True)]
    assert sum(r.share for r in activity.shares(named).collect()) == pytest.approx(1)


def test_activity_does_not_depend_on_periods(spark):
    """Runs over many periods, periods of one row, and null modes."""
    rng = random.Random(5)
    rows = [(user, k, mode) for user in ("a", "b", None) for k, mode in enumerate(m for _ in range(40) for m in [rng.choice(["walk", "bike", "transport", None])] * rng.choice([1, 1, 2, 3, 9]))]
    line = spark.createDataFrame(rows, "user_id string, time int, mode string")
    for form in (activity.smooth, activity.islands, activity.changes):
        want = sorted(map(str, form(line).collect()))
        assert len(want) > 10
        for length in (1, 2, 5, 50):
            assert sorted(map(str, form(line, F.floor(F.col("time") / length)).collect())) == want


def test_model_round(spark, tmp_path):
    rows = []
    for k in range(300):
        label = ("walk", "bike", "transport")[k % 3]
        speed = {"walk": 1.0, "bike": 5.0, "transport": 15.0}[label] + (k % 7) / 10
        rows.append((f"u{k % 40}", *[speed] * len(features.FEATURES), label))
    df = spark.createDataFrame(rows, "user_id string, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", label string")
    weights = modes.class_weights(df)
    assert {round(r.weight, 6) for r in weights.collect()} == {1.0}
    training, test = modes.split(df)
    assert training.count() + test.count() == 300 and not {r.user_id for r in training.collect()} & {r.user_id for r in test.collect()}
    model = modes.train(modes.weighted(training, weights), trees=5, depth=4)
    assert model.stages[-1].numClasses == 4  # one more for unseen labels
    told = modes.predict(model, test)
    m = modes.metrics(told).first()
    assert m.accuracy > 0.95 and m.f1 > 0.95
    assert modes.confusion(told).columns == ["actual", "transport", "walk", "bike"]
    modes.save(model, str(tmp_path / "m"))
    modes.save_report(told, str(tmp_path / "r"))
    best = modes.tune(modes.weighted(df, weights), trees=(3,), depths=(2, 3), folds=2)
    assert len(best.avgMetrics) == 2
    assert set(modes.predict(model, test.drop("label")).columns) == set(test.columns) - {"label"} | {"predicted"}


def test_trajectory_and_label_files(spark, tmp_path):
    head = "Geolife trajectory\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n"
    for user, n in (("000", 3), ("010", 2)):
        (tmp_path / user / "Trajectory").mkdir(parents=True)
        for f in range(2):
            (tmp_path / user / "Trajectory" / f"{f}.plt").write_text(head + "".join(f"39.9{k},116.3{k},0,49{k},39744.1,2008-10-2{f},02:53:0{k}\r\n" for k in range(n)) + "bad,line,0,0,0,2008-10-20,02:53:10\n")
    (tmp_path / "010" / "labels.txt").write_text("Start Time\tEnd Time\tTransportation Mode\n2008/10/20 02:00:00\t2008/10/20 03:00:00\tbus\n")
    points, labels = trajectories.trajectories(spark, str(tmp_path)), trajectories.labels(spark, str(tmp_path))
    assert points.count() == 10
    r = points.filter("user_id = '000'").orderBy("event_time").first()
    assert (r.lat, r.lng, r.altitude, str(r.event_time)) == (39.90, 116.30, 490.0, "2008-10-20 02:53:00")
    assert [(x.user_id, x.label, str(x.start_time)) for x in labels.collect()] == [("010", "bus", "2008-10-20 02:00:00")]
    assert {x.user_id for x in trajectories.of_labelled_users(points, labels).collect()} == {"010"}


def test_messages(spark):
    sent = fixtures.messages(spark, SMALL)
    accepted, rejected = wire.accept(sent, "sent_as")
    assert accepted.count() + rejected.count() == sent.count()
    assert {r.why for r in rejected.select("why").distinct().collect()} == {"malformed", "id mismatch", "no time", "no position"}
    again = wire.pings(accepted)
    assert again.filter("id is null or event_time is null or lat is null").count() == 0
    assert wire.encode(again, "id").columns == ["key", "value"]
    bad = wire.decode(spark.createDataFrame([("{",), ("[]",), (None,), ('{"id": 5}',)], "value string"))
    assert [r.id for r in bad.collect()] == [None, None, None, "5"]


def test_similar_against_every_pair(spark):
    import random

    draw = random.Random(3)
    rows = []
    for i in range(40):
        lat, lng = ((37.5, 127.0), (0.0, 179.9999), (-0.0001, -179.9999), (89.9995, 10.0))[i % 4]
        path = [(lng + k * 0.0004 + draw.uniform(0, 0.0011), lat + draw.uniform(0, 0.0011) * (lat < 89)) for k in range(draw.randint(9, 14))]
        rows.append((i, [(x - 360 if x > 180 else x, y) for x, y in path]))
    table = spark.createDataFrame(rows, "r long, path array<struct<lng: double, lat: double>>")
    pairs = table.selectExpr("r as a", "path as pa").join(table.selectExpr("r as b", "path as pb"), F.expr("a < b"))
    every = pairs.select("a", "b", paths.frechet_m(F.col("pa"), F.col("pb")).alias("m")).filter("m <= 170").collect()
    got = {(r.a, r.b): r.metres for r in paths.similar(table, "r", 170.0).collect()}
    assert len(every) > 20
    assert got == {(r.a, r.b): pytest.approx(r.m, abs=1e-6) for r in every}


def test_paths_are_whole(spark):
    from meridian.plans import catalog, fixtures

    sf_dir = "/root/testdata/sf0.001"
    places = {r.user_id: r["count"] for r in fixtures.events(spark, sf_dir).groupBy("user_id").count().collect()}
    assert {r.user_id: len(r.path) for r in catalog._paths(spark, sf_dir).collect()} == places


def test_path_clusters_against_brute_force(spark):
    """The registered query against all pairs and a plain search of clusters."""
    from meridian.plans import catalog

    got = catalog.path_clusters(spark, MEDIUM).collect()
    whole = sorted((r.user_id, [(p.lng, p.lat) for p in r.path]) for r in catalog._paths(spark, MEDIUM).collect())
    users, places = [u for u, _ in whole], [pa.array([{"lng": x, "lat": y} for x, y in path]) for _, path in whole]
    every = [(i, j) for j in range(len(users)) for i in range(j)]

    def side(k):
        column = pa.array([places[p[k]].to_pylist() for p in every], pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())])))
        return paths._globe(column)

    # distances themselves are tested against every pair above
    metres = paths.frechet_many(side(0), side(1), 170.0)
    far = {(min(users[i], users[j]), max(users[i], users[j])): m for (i, j), m in zip(every, metres.tolist(), strict=True) if m == m}
    near = {u: {v for v in users if (min(u, v), max(u, v)) in far} for u in users}
    cores = {u for u in users if len(near[u]) + 1 >= 3}
    cluster = {u: u for u in cores}
    changed = True
    while changed:
        changed = False
        for u in cores:
            least = min([cluster[u], *(cluster[v] for v in near[u] & cores)])
            changed |= least < cluster[u]
            cluster[u] = least
    for u in users:
        if u not in cores:
            cluster[u] = min((cluster[v] for v in near[u] & cores), default=None)
    assert {r.user_id: r.cluster for r in got} == cluster and any(cluster.values())
    assert {r.user_id: r.cluster for r in catalog.path_dense_clusters(spark, MEDIUM).collect()} == cluster
    for c in {c for c in cluster.values() if c is not None}:
        mine = [u for u in users if cluster[u] == c]
        links = {u: [far[min(u, v), max(u, v)] for v in mine if v in near[u]] for u in mine}
        central = min((u for u in mine if links[u]), key=lambda u: (-len(links[u]), sum(links[u]) / len(links[u]), u))
        assert {(r.medoid, r.n) for r in got if r.cluster == c} == {(central, len(mine))}


def ways(spark):
    """Bundles of like paths, two bundles a little apart, chains between bundles, and strays."""
    pick, rows = random.Random(12), []

    def add(n, lat, lng, spread, step=0.0004):
        for _ in range(n):
            a, b = lat + pick.uniform(-spread, spread), lng + pick.uniform(-spread, spread)
            rows.append((len(rows), [(b + k * step, a) for k in range(pick.randint(8, 11))]))

    add(40, 37.5, 127.0, 0.0002)
    add(12, 37.5013, 127.0, 0.0002)
    add(9, 37.5025, 127.0, 0.0007)
    add(30, 37.52, 127.0, 0.0003)
    add(25, 37.53, 127.02, 0.004)
    rows.append((len(rows), []))
    return spark.createDataFrame(rows, "r long, path array<struct<lng: double, lat: double>>")


@pytest.mark.parametrize(("most", "fewest"), [(170.0, 3), (120.0, 6), (90.0, 1)])
def test_dense_balls_give_the_clusters_of_all_pairs(spark, most, fewest):
    table = ways(spark)
    want = {r.r: r.cluster for r in paths.clusters(table, paths.similar(table, "r", most), "r", fewest).collect()}
    got = {r.r: r.cluster for r in paths.dense_clusters(table, "r", most, fewest).collect()}
    # a route without places is in reach of nothing
    assert {k: v for k, v in got.items() if k != len(want) - 1} == {k: v for k, v in want.items() if k != len(want) - 1}
    assert len(set(got.values())) > 2


def test_a_hub_of_like_paths_takes_no_pairs(spark):
    rows = [(k, [(127.0 + i * 0.0004, 37.5 + k % 9 * 1e-5) for i in range(12)]) for k in range(300)]
    located = paths._located(spark.createDataFrame(rows, "r long, path array<struct<lng: double, lat: double>>"), "r")
    members = paths.balls(located, 170.0, 3)
    assert members.count() == 300
    loose, between = paths.links_outside_balls(located, members, 170.0)
    assert loose.count() == 0 and between.count() <= 10


def test_forest_predicts_each_row_of_the_test_side(spark):
    from meridian.plans import catalog

    got = sorted((r.user_id, r.window_start, r.label) for r in catalog.forest_predictions(spark, SMALL).collect())
    _, test = modes.split(catalog._labelled(spark, SMALL))
    want = sorted((r.user_id, r.s, r.label) for r in test.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("s"), "label").collect())
    assert got == want
    assert {r.predicted for r in catalog.forest_predictions(spark, SMALL).collect()} <= set(modes.LABELS)


def test_tuning_takes_the_better_forest(spark):
    """Two classes that one cut can't part: the deeper trees win, on a fixed seed."""
    pick = random.Random(6)
    rows = []
    for k in range(240):
        x, y = pick.random(), pick.random()
        rows.append((f"u{k % 12}", *[x if i % 2 else y for i in range(len(features.FEATURES))], "walk" if (x < 0.5) == (y < 0.5) else "bike", 1.0))
    table = spark.createDataFrame(rows, "user_id string, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", label string, weight double")
    found = modes.tune(table, trees=(3,), depths=(1, 6), folds=2)
    assert found.avgMetrics[1] > found.avgMetrics[0] + 0.1
    assert found.bestModel.stages[-1].getOrDefault("maxDepth") == 6
    assert modes.metrics(modes.predict(found.bestModel, table)).first().accuracy > 0.9
