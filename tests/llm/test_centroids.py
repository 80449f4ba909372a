import hashlib
import math

import duckdb

from meridian.llm import centroids

MEDIUM = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    got = centroids.query(spark, MEDIUM)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{MEDIUM}/embeddings.parquet'")
    want = db.sql(centroids.ORACLES["op11_centroids"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def plain(rows, k, rounds, size, scale, seed):
    """Rows (id, vector) clustered in Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    by_hash = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] is not None and hashlib.sha256(f"{seed}:{kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    middle = [whole[j][1] for j in by_hash[:k]]

    def nearest():
        out = []
        for _, v in whole:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in middle]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = nearest()
        for c in range(len(middle)):
            mine = [v for (_, v), (label, _) in zip(whole, at, strict=True) if label == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = nearest()
    total = sum(d for _, d in at)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, sum(e for b, e in at if b == c), total, digest[c]) for (i, _), (c, d) in zip(whole, at, strict=True)), key=str)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
ROWS = [(i, [((i * 37 + d * 11) % 23 - 11) / 7 for d in range(3)]) for i in range(60)]
ODD = [
    (100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, 2.0, 3.0, 4.0]), (104, [1.0, None, 2.0]), (105, [1.0, float("nan"), 2.0]), (106, [1.0, float("inf"), 2.0]), (107, [1.0, -math.inf, 2.0]),
    (None, [0.5, -0.5, 0.25]), (None, [0.5, -0.5, 0.25]), (7, [9.0, 9.0, -9.0]), (108, [0.0, -0.0, 0.0]), (109, [1e-300, -1e-300, 0.1]),
]


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids string").repartition(3)
    return sorted((tuple(r) for r in centroids.clustered(df, size=3, scale=10, **how).select(*COLUMNS).collect()), key=str)


def test_odd_rows_against_plain_python(spark):
    rows = ROWS + ODD + ROWS[:5]
    assert clustered(spark, rows, k=4, rounds=5) == plain(rows, 4, 5, 3, 10, 3)
    assert clustered(spark, rows, k=6, rounds=1, seed=9) == plain(rows, 6, 1, 3, 10, 9)


def test_few_and_equal_vectors(spark):
    same = [(i, [1.0, 1.0, 1.0]) for i in range(9)]
    got = clustered(spark, same, k=4, rounds=3)
    assert got == plain(same, 4, 3, 3, 10, 3) and {r[1] for r in got} == {0}  # ties go to the first; the others stay empty
    assert clustered(spark, ROWS[:2], k=5, rounds=3) == plain(ROWS[:2], 5, 3, 3, 10, 3)
    assert clustered(spark, ODD[:8]) == [] and clustered(spark, []) == []


def test_far_components_are_held_back(spark):
    got = clustered(spark, [(1, [1e300, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])], k=1, rounds=0)
    assert {r[2] for r in got} <= {0, centroids.REACH**2, (2 * centroids.REACH) ** 2}


def test_blocks_hold_the_occurring_numbers(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>").coalesce(1)
    row = centroids.blocks(df, "vec_id", "embedding", 3, 10).first()
    block = centroids.Block(row.n, row.codes, row.counts, row.numbers)
    for d in range(3):
        assert block.numbers[d][block.codes[d]].tolist() == [math.floor(10 * v[d]) for _, v in ROWS]
