"""The box around encounters, from the pings along its edges."""

import random

from meridian.operators import proximity

from .test_streaming import at


def test_box_of_pings_is_the_box_of_all_encounters_from_fewer_pings(spark, monkeypatch):
    pick = random.Random(3)
    rows = [(f"u{pick.randrange(40)}", at(pick.randrange(60)), 37.5 + pick.random() / 100, 127 + pick.random() / 100) for _ in range(4000)]
    # alone at an edge; far from all others; and nobody's neighbour
    rows += [("far", at(5), 37.49, 127.005), ("late", at(900), 37.505, 126.9)]
    pings = spark.createDataFrame(rows, "id string, event_time timestamp, lat double, lng double").cache()
    whole = proximity.near_pairs
    want = proximity.bounding_box(proximity.encounters(whole(pings))).collect()
    seen = []
    monkeypatch.setattr(proximity, "near_pairs", lambda p, *a, **k: seen.append(p.count()) or whole(p, *a, **k))
    assert proximity.box_of_pings(pings).collect() == want
    assert max(seen) < len(rows)


def test_box_of_pings_over_the_180th_meridian_and_of_none(spark):
    rows = [("a", at(1), 10.0, 179.99995), ("b", at(1), 10.0, -179.99995), ("c", at(2), 0.0, 0.0), ("d", at(2), 0.0, 0.0001)]
    pings = spark.createDataFrame(rows, "id string, event_time timestamp, lat double, lng double")
    want = proximity.bounding_box(proximity.encounters(proximity.near_pairs(pings))).collect()
    assert proximity.box_of_pings(pings).collect() == want
    none = proximity.box_of_pings(pings.filter("id = 'a'")).collect()
    assert none == proximity.box_of_pings(pings.filter("false")).collect() and none[0].south is None


def test_first_encounters_are_told_apart_before_pairs_are_turned_round(spark, tmp_path):
    """Half the rows are grouped, and both orders of a pair have the same first event."""
    from meridian.plans import catalog

    found = catalog.QUERIES["first_encounters"](spark, "/root/testdata/sf0.01")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate explode(array(struct(user1_id") < plan.index("Aggregate [user1_id")
    both = found.join(found.toDF("user2_id", "user1_id", "t", "a", "b"), ["user1_id", "user2_id"])
    assert both.filter("t = encounter_time and a = lat and b = lng").count() == found.count() > 0
