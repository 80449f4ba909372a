import zlib

import numpy as np
import pyarrow.parquet as pq

from meridian.llm import quality

MEDIUM = "/root/testdata/sf0.01"


def test_query_separates_held_out_labels(spark):
    got = {r.doc_id: r for r in quality.query(spark, MEDIUM).collect()}
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    assert sorted(got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    labels = pq.read_table(f"{MEDIUM}/labels.parquet").to_pydict()
    held = [(got[d].predicted, q) for d, q in zip(labels["doc_id"], labels["quality"], strict=True) if got[d].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    clean = [p for p, q in held if q == 1]
    assert sum(clean) / len(clean) > 0.97


def test_learns_an_interaction():
    draw = np.random.default_rng(1)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :4] = draw.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in [p[:2] for p in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_odd_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n ", "s"), (3, " \n ", "s"), (None, "a", None), (4, "word " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (3, None), (3, 1), (3, 1)], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none).collect() == []


def test_query_is_the_brute_force_score(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    got = {r.doc_id: r for r in quality.query(spark, MEDIUM).collect()}
    for r in docs.filter("doc_id % 5 = 1").collect():
        x, total = quality.features(r.text), model.intercept
        at = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        total += sum(t[i] for t, i in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        want = 1 / (1 + np.exp(-total))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.3)


def test_repeated_and_string_ids(spark):
    rows = [(f"n{i}", "good words in a row. " * 5 if i % 2 else "## $$ %%", i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [("n1", "zz again")] * 10000, "doc_id string, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id string, quality int")
    once = docs.dropDuplicates()
    a, b = (quality.train(d, labels) for d in (docs, once))
    assert a.intercept == b.intercept and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_a_repeated_label_does_not_swallow_the_sample(spark):
    rows = [(i, "good words in a row. " * 5 if i % 2 else "## $$ %%", i % 2) for i in range(1, 201)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 1)] * 25000, "doc_id long, quality int")
    model = quality.train(docs, labels, sample=300)
    found = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    assert found[2] < 0.2 < 0.8 < found[3]
