import re

import pyarrow.parquet as pq
import pytest
import xxhash

from meridian.llm import simhash
from meridian.operators import components

MEDIUM = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", folded)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, distance=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_query_against_brute_force(spark):
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    fps = [plain_fingerprint(t) for t in docs["text"]]
    want = {(d, format(f, "016x"), c) for d, f, c in zip(docs["doc_id"], fps, plain_components(fps, docs["doc_id"]), strict=True)}
    got = [tuple(r) for r in simhash.query(spark, MEDIUM).collect()]
    assert len(got) == len(want)
    assert set(got) == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (None, "one two", "x"), (5, "one\ttwo", "x"), (6, "ONE  Two ", "x"), (7, "solo", None), (7, "solo", None), (8, "a b c " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    texts = [r[1] for r in rows]
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(zip([r[0] for r in rows], fps, plain_components(fps, [r[0] for r in rows]), strict=True), key=str)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


@pytest.mark.parametrize("block, distance", [(8, 3), (4096, 3), (64, 7), (4096, 11)])
def test_dense_ball_in_blocks(spark, monkeypatch, block, distance):
    import random

    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(5)
    base = draw.getrandbits(64)
    fps = {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for _ in range(150)} | {draw.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f, f, 0) for f in signed], "node long, fp long, check long"), distance)
    roots = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    groups, want = {}, {}
    for f, s, c in zip(fps, signed, plain_components(fps, list(range(len(fps))), distance), strict=True):
        groups.setdefault(roots.get(s, s), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_plan_thresholds_cover_distance():
    import numpy as np

    for n in (0, 1, 1000, 10**7, 10**9):
        for distance in (3, simhash.REACH):
            both = np.full((64, 64), n / 4)
            np.fill_diagonal(both, n / 2)
            parts = simhash.plan(n, both, distance)
            assert sorted(b for bits, _ in parts for b in bits) == list(range(64))
            assert sum(t for _, t in parts) == distance - len(parts) + 1


def sets_of(texts, width=5):
    return [set(simhash.shingles((t or "").encode(), width).tolist()) for t in texts]


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def plain_similar(texts):
    """A group number for each text: links by brute force over fingerprints and shingle sets."""
    hashes = [simhash.shingles((t or "").encode(), 5) for t in texts]
    prints = [(simhash.majority(h), simhash.majority(simhash.mixed(h))) for h in hashes]
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i][0] ^ prints[j][0]).bit_count() <= simhash.REACH and (prints[i][1] ^ prints[j][1]).bit_count() <= simhash.CHECK and alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [False, True])
def test_similar_texts_against_brute_force(spark, monkeypatch, small):
    if small:  # every file and group is dealt in blocks
        monkeypatch.setattr(simhash, "BLOCK", 32)
        monkeypatch.setattr(simhash, "VERIFIED", 4000)
        monkeypatch.setattr(simhash, "MEMBERS", 3)
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = plain_similar(docs["text"])
    got = {r.doc_id: r.group for r in simhash.similar_texts(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()}
    assert len(got) == len(want)
    pairs = {(got[d], w) for d, w in zip(docs["doc_id"], want, strict=True)}
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})
    # of the pairs with that similarity, most share a group
    sets = sets_of(docs["text"])
    near = [(i, j) for i in range(len(sets)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j])]
    found = sum(want[i] == want[j] for i, j in near)
    assert found >= 0.97 * len(near)


def test_unlike_texts_are_not_chained(spark):
    words = [f"w{i}" for i in range(100)]
    steps = [" ".join(words[:k] + [f"new{i}" for i in range(k, 100)][: 100 - k]) for k in range(100, 40, -10)]
    rows = [(i, t) for i, t in enumerate(steps)]
    got = {r.doc_id: r.group for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] != got[5]


def test_similar_texts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (5, "one\ttwo"), (6, "ONE  Two "), (7, "solo"), (7, "solo"), (7, "other text"), (8, "a b c " * 30000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    got = sorted(((str(r.doc_id), r.group) for r in simhash.similar_texts(docs).collect()), key=lambda r: r[0])
    assert len(got) == len(rows)
    by = {}
    for d, g in got:
        by.setdefault(g, []).append(d)
    assert sorted(by.values()) == sorted([["1", "2", "3"], ["5", "6", "None"], ["7", "7"], ["7"], ["8"]])
    assert simhash.similar_texts(docs.limit(0)).collect() == []
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert len(simhash.similar_texts(named).collect()) == len(rows)


def test_hot_keys_are_spread(spark, monkeypatch):
    from meridian.operators import skew

    monkeypatch.setattr(skew, "HOT", 4)
    left = spark.range(5000).selectExpr("if(id < 4000, 7, id) as k", "id")
    right = left.select("k").distinct().selectExpr("k", "k * 2 as v")
    hot = skew.hot_values(left.groupBy("k").count(), "k", "count")
    assert hot == [7]
    assert sorted(map(tuple, skew.spread_join(left, right, "k", hot).collect())) == sorted((7 if i < 4000 else i, i, 14 if i < 4000 else 2 * i) for i in range(5000))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 240)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 240)]}
