import random

from meridian.operators import paths


def test_paths_that_cross_one_hub_take_no_pairs(spark):
    """Paths over a hub, in reach of each other but mostly not within half of it."""
    pick = random.Random(3)
    rows = [(k, [(127.0 + pick.uniform(0, 0.0014), 37.5 + pick.uniform(0, 0.0011)) for _ in range(12)]) for k in range(240)]
    located = paths._located(spark.createDataFrame(rows, "r long, path array<struct<lng: double, lat: double>>"), "r")
    members = paths.balls(located, 180.0, 3)
    assert members.count() > 230 and members.select("ball").distinct().count() == 1
    assert paths.links_outside_balls(located, members, 180.0)[1].count() == 0
