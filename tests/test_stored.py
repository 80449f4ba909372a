from pyspark.sql import functions as F

from meridian.functions import parse
from meridian.plans import catalog
from meridian.sources import store

from .conftest import SMALL


def test_messages_are_read_as_by_path(spark):
    whole = '{"user1_id":"a","user2_id":"b","encounter_time":"2024-01-01T00:00:01.5Z","position":{"lat":37.5,"lng":1e2}}'
    odd = ['{"user1_id":7,"position":{"lat":"x","lng":null}}', '{"position":"none","user2_id":"b"}', "{}", "nothing", "", None, '{"encounter_time":"soon","user1_id":"\\u00e9\\""}', '{"position":[1,2],"user1_id":null}', whole[:60], '{"user1_id":{"k":1}}']
    sent = spark.createDataFrame([(v,) for v in [whole, *odd]], "value string")
    v = F.col("value")
    by_path = [
        parse.event_time(F.get_json_object(v, "$.encounter_time")),
        *[parse.json_string(v, f"$.{c}") for c in ("user1_id", "user2_id")],
        *[parse.json_double(v, f"$.position.{c}") for c in ("lat", "lng")],
    ]
    assert [tuple(r) for r in store.encounter_rows(sent).collect()] == [tuple(r) for r in sent.select(*by_path).collect()]


def test_events_are_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "fresh_path", lambda *_: str(tmp_path / "t"))
    monkeypatch.setattr(catalog.fixtures, "NEAR", 60_000)
    catalog.stored_encounters(spark, SMALL)
    stored = store.read(spark, str(tmp_path / "t"))
    assert stored.count() > 0 and stored.filter("user1_id >= user2_id").count() == 0
