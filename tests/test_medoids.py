from meridian.operators import paths
from meridian.plans import catalog


def test_medoids_take_no_table_of_pairs(spark, monkeypatch, tmp_path):
    """One hub of 300 users: 44,850 pairs of paths, nearly all linked."""
    events = spark.range(3000).selectExpr(
        "id as event_id", "cast(timestamp_seconds(1704067200 + id * 900) as timestamp_ntz) as ts", "id % 300 * 12 as user_id", "'click' as event_type", "1D as value", "'{}' as props"
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    whole = catalog._paths(spark, str(tmp_path)).localCheckpoint()
    links = paths.similar(whole, "user_id", 170.0).localCheckpoint()
    members = paths.clusters(whole, links, "user_id", 3)
    want = {r.cluster: (r.user_id, r.n) for r in paths.medoids(members, links, "user_id").collect()}
    assert links.count() > 20_000 and len(want) == 1

    rows, stored = [], paths.stored

    def counted(df, label):
        kept = stored(df, label)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(paths, "stored", counted)
    monkeypatch.setattr(catalog, "stored", counted)
    got = catalog.path_clusters(spark, str(tmp_path)).collect()
    assert {r.cluster: (r.medoid, r.n) for r in got if r.cluster is not None} == want
    assert len(got) == 300 and max(rows) <= 3000


def test_ends_bound_links_and_lengths(spark):
    """No look at ends gives fewer links, or as many and longer ones, than whole paths have; short paths too."""
    import random

    pick = random.Random(5)
    rows = [(0, k, [(127.0 + pick.uniform(0, 0.0016), 37.5 + pick.uniform(0, 0.0012)) for _ in range(pick.randint(1, 12))]) for k in range(80)]
    inside = spark.createDataFrame(rows, "cluster long, r long, path array<struct<lng: double, lat: double>>").localCheckpoint()
    tried = inside.select("cluster", "r")
    exact = {r.r: (-r.links, r.nm) for r in paths._scored(tried, inside, 170.0).collect()}
    assert len(exact) == 80 and len(set(exact.values())) > 70
    for depth in (1, 3, 8, 24):
        bounds = {r.r: (-r.links, r.nm - 1000) for r in paths._scored(tried, inside, 170.0, depth).collect()}
        assert bounds.keys() == exact.keys() and all(bounds[k] <= exact[k] for k in exact)
