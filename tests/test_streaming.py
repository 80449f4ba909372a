from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meridian.operators import density, proximity
from meridian.plans import fixtures
from meridian.sources import pings as wire
from meridian.sources import store
from meridian.streaming import jobs

from .conftest import SMALL

T0 = datetime(2024, 1, 1)
SCHEMA = "id string, event_time timestamp, lat double, lng double"


class Feed:
    """Files that arrive one after the other."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        path.mkdir()

    def add(self, rows):
        df = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(self.path))

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(str(self.path))


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def state_rows(query):
    return [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]


def test_density_stream_equals_batch_and_drops_state(spark, tmp_path):
    pings = fixtures.pings(spark, SMALL).select("id", "event_time", "lat", "lng")
    feed = Feed(spark, tmp_path / "in")
    early = F.col("event_time") < F.lit("2024-01-15").cast("timestamp")
    out = str(tmp_path / "rows")
    for part in (pings.filter(early), pings.filter(~early)):
        feed.add(part)
        query = jobs.run_available(jobs.hourly_density(feed.stream()), str(tmp_path / "cp"), jobs.into_batches(out), "update")
    assert state_rows(query)[0] < 20  # hours that the watermark has passed are gone
    got = {tuple(r) for r in jobs.latest_density(store.read(spark, out)).collect()}
    assert got == {tuple(r) for r in density.hourly(pings, approximate=True).collect()}


def test_update_rows_are_cumulative_and_the_last_holds(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in"), str(tmp_path / "rows")
    for ids in ("ab", "bc"):
        feed.add([(i, at(60), 37.5, 127.0) for i in ids])
        jobs.run_available(jobs.hourly_density(feed.stream()), str(tmp_path / "cp"), jobs.into_batches(out), "update")
    rows = store.read(spark, out)
    assert sorted(r.visitors for r in rows.collect()) == [2, 3]
    assert [r.visitors for r in jobs.latest_density(rows).collect()] == [3]


def test_encounter_stream_equals_batch(spark, tmp_path):
    pings = fixtures.pings(spark, SMALL, 6000).select("id", "event_time", "lat", "lng")
    feed, out = Feed(spark, tmp_path / "in"), str(tmp_path / "rows")
    feed.add(pings)
    jobs.run_available(jobs.first_encounters(jobs.encounters(feed.stream()), for_ever=True).drop("time1"), str(tmp_path / "cp"), jobs.into_batches(out))
    got = [tuple(r) for r in store.read(spark, out).select("user1_id", "user2_id").collect()]
    want = {tuple(r) for r in proximity.near_pairs(pings).select("user1_id", "user2_id").collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_encounters_across_batches_with_late_rows_and_eviction(spark, tmp_path):
    feed, out, cp = Feed(spark, tmp_path / "in"), str(tmp_path / "rows"), str(tmp_path / "cp")
    place = (37.5, 127.0)

    def go():
        return jobs.run_available(jobs.first_encounters(jobs.encounters(feed.stream())).drop("time1"), cp, jobs.into_batches(out))

    feed.add([("a", at(100), *place)])
    go()
    feed.add([("b", at(103), *place)])  # within 5 s of a, in a later batch
    go()
    feed.add([("c", at(1000), *place)])
    go()
    feed.add([("d", at(101), *place)])  # later than the watermark allows
    query = go()
    got = {(r.user1_id, r.user2_id) for r in store.read(spark, out).collect()}
    assert got == {("a", "b"), ("b", "a")}
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) > 0
    assert max(state_rows(query)) <= 20


def test_bounded_dedup_forgets_and_unbounded_does_not(spark, tmp_path):
    place = (37.5, 127.0)
    for for_ever, want in ((False, 2), (True, 1)):
        feed, out, cp = Feed(spark, tmp_path / f"in{for_ever}"), str(tmp_path / f"rows{for_ever}"), str(tmp_path / f"cp{for_ever}")
        for s in (100, 1000, 2000, 3000):
            meet = s in (100, 2000)
            feed.add([("a", at(s), *place), ("b" if meet else "z", at(s + 1), place[0] + (0 if meet else 0.5), place[1])])
            jobs.run_available(jobs.first_encounters(jobs.encounters(feed.stream()), for_ever).drop("time1"), cp, jobs.into_batches(out))
        n = store.read(spark, out).filter("user1_id = 'a' and user2_id = 'b'").count()
        assert n == want


def test_one_per_second(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in"), str(tmp_path / "rows")
    feed.add([("a", at(1.2), 1.0, 1.0), ("a", at(1.9), 1.0, 1.0), ("a", at(2.0), 1.0, 1.0), ("b", at(1.5), 1.0, 1.0)])
    jobs.run_available(jobs.one_per_second(feed.stream()), str(tmp_path / "cp"), jobs.into_batches(out))
    assert sorted((r.id, r.event_time.second) for r in store.read(spark, out).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_messages_through_a_stream_into_the_table(spark, tmp_path):
    lines = tmp_path / "lines"
    fixtures.messages(spark, SMALL).select("value").coalesce(2).write.text(str(lines))
    accepted, _ = wire.accept(wire.folder(spark, str(lines), 1))
    out = str(tmp_path / "rows")
    jobs.run_available(wire.tapped(wire.pings(accepted), "pings"), str(tmp_path / "cp"), jobs.into_batches(out))
    want, _ = wire.accept(fixtures.messages(spark, SMALL))
    assert store.read(spark, out).count() == want.count()


def test_partials_sink_bears_repetition(spark, tmp_path):
    sink, counts = jobs.into_partials(str(tmp_path / "p")), density.hourly(fixtures.pings(spark, SMALL))
    sink(counts, 3)
    sink(counts, 3)
    assert store.merged(store.read(spark, str(tmp_path / "p"))).count() == counts.count()


def test_live_predictions(spark, tmp_path):
    """A model that was fitted on a table predicts on a stream of features."""
    from meridian.operators import features, modes

    rows = [(f"u{k % 9}", *[float(k % 3 * 6 + k % 5 / 10)] * len(features.FEATURES), ("walk", "bike", "transport")[k % 3], 1.0) for k in range(90)]
    table = spark.createDataFrame(rows, "user_id string, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", label string, weight double")
    model = modes.train(table, trees=3, depth=3)
    table.drop("label", "weight").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(table.drop("label", "weight").schema).parquet(str(tmp_path / "in"))
    jobs.run_available(modes.predict(model, live), str(tmp_path / "cp"), jobs.into_batches(str(tmp_path / "rows")))
    got = {(r.avg_speed >= 6, r.avg_speed >= 12, r.predicted) for r in store.read(spark, str(tmp_path / "rows")).collect()}
    assert got == {(False, False, "walk"), (True, False, "bike"), (True, True, "transport")}


def test_state_on_disk_lasts_over_restarts(spark, tmp_path):
    """Pairs that met are remembered for ever, in a store outside the heap, from run to run; crowded keys in parts."""
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")
    before = {n: spark.conf.get(n, None) for n in names}
    jobs.keep_state_on_disk(spark)
    try:
        feed, out, place = Feed(spark, tmp_path / "in"), str(tmp_path / "rows"), (37.5, 127.0)
        for s in (100, 1000, 2000):
            feed.add([("a", at(s), *place), ("b", at(s + 1), *place), (f"x{s}", at(s), *place)])
            events = jobs.first_encounters(jobs.encounters(feed.stream(), parts=3), for_ever=True).drop("time1")
            query = jobs.run_available(events, str(tmp_path / "cp"), jobs.into_batches(out))
        got = [(r.user1_id, r.user2_id) for r in store.read(spark, out).collect()]
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert len(got) == len(set(got)) == 2 + 3 * 4
    assert any("rocksdb" in k for s in query.lastProgress["stateOperators"] for k in s["customMetrics"])


def test_metrics_of_batches_are_a_table(spark, tmp_path):
    from meridian.streaming import metrics

    feed, recorder = Feed(spark, tmp_path / "in"), metrics.Recorder(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(recorder)
    try:
        for rows in ([("a", at(5000), 1.0, 1.0), ("b", at(5000), None, 1.0)], [("c", at(10), 1.0, 1.0), ("d", at(5001), 1.0, 1.0)]):
            feed.add(rows)
            jobs.run_available(jobs.one_per_second(wire.tapped(feed.stream(), "tap")), str(tmp_path / "cp"), jobs.into_batches(str(tmp_path / "rows")))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(recorder)
    assert recorder.failed == []
    found = {(r.source, r.metric): r.v for r in recorder.table().groupBy("source", "metric").agg(F.sum("value").alias("v")).collect()}
    assert found["tap", "rows"] == 4 and found["tap", "no_lat"] == 1
    assert metrics.late_rows(recorder.table()).first().late == 1


class Calls:
    """Stands for a reader or writer and keeps what it is told."""

    def __init__(self):
        self.told = {}

    def option(self, name, value):
        self.told[name] = value
        return self

    def __getattr__(self, name):
        def call(*values):
            self.told[name] = values
            return self

        return call


def test_options_of_topics():
    class Session:
        readStream = Calls()

    wire.topic(Session, "one:9092,two:9092", "pings")
    assert Session.readStream.told == {"format": ("kafka",), "kafka.bootstrap.servers": "one:9092,two:9092", "subscribe": "pings", "startingOffsets": "earliest", "load": ()}

    class Messages:
        writeStream = Calls()

    wire.to_topic(Messages, "one:9092", "encounters", "/cp", "update")
    assert Messages.writeStream.told == {"format": ("kafka",), "outputMode": ("update",), "kafka.bootstrap.servers": "one:9092", "topic": "encounters", "checkpointLocation": "/cp"}


def test_what_is_sent_has_key_and_value(spark):
    rows = spark.createDataFrame([("a", 1, (2.0, 3.0))], "id string, n long, position struct<lat: double, lng: double>")
    sent = wire.encode(rows, "id")
    assert sent.dtypes == [("key", "string"), ("value", "string")]
    assert tuple(sent.first()) == ("a", '{"id":"a","n":1,"position":{"lat":2.0,"lng":3.0}}')
    assert wire.encode(rows).columns == ["value"]
