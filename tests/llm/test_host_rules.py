import re

import duckdb
import pyarrow.parquet as pq

from meridian.llm import host_rules

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_query_against_sql_and_brute_force(spark):
    got = sorted(tuple(r) for r in host_rules.query(spark, MEDIUM).collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{MEDIUM}/documents.parquet'")
    assert got == sorted(db.sql(host_rules.SQL).fetchall())
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert [r[:7] for r in got] == sorted((d, *plain(t)) for d, t in zip(docs["doc_id"], docs["text"], strict=True))


def test_bad_host_is_blocked_and_small_host_is_not(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    rows = [(i, bad if i % 10 else good, "bad", 0) for i in range(200)] + [(1000 + i, good if i % 20 else bad, f"h{i % 9}", 0) for i in range(2000)] + [(5000, bad, "one", 0), (5001, good, "one", 0), (5002, good, None, 0), (5003, good, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    kept = {r.doc_id: r.kept for r in host_rules.judge(docs).collect()}
    assert len(kept) == len(rows)
    assert not any(kept[i] for i in range(200))
    assert kept[5001] and kept[5002] and not kept[5000]
    assert all(kept[1000 + i] == bool(i % 20) for i in range(2000))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "\n \t\n", None), (3, "\n \t\n", None), (None, "é* x\x0by\n\né* x\x0by\n", "b"), (4, "a b c d " * 20000, "b"), (5, " ".join(map(str, range(9))) + " x " + " ".join(map(str, range(8))), "b")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, n_words string")
    got = host_rules.measure(docs).select("doc_id", *host_rules.MEASURES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *plain(t)) for d, t, _ in rows), key=str)
    assert len(host_rules.judge(docs).collect()) == len(rows)
    assert host_rules.judge(docs.limit(0)).collect() == []


def test_verdict_is_relative_to_the_table(spark):
    """A host that fails in a third of its rows is blocked where a twentieth is usual; a short run of bad luck isn't."""
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    rows = [(i, bad if i % 3 == 0 else good, "poor") for i in range(900)] + [(1000 + i, bad if i % 20 == 0 else good, f"h{i % 13}") for i in range(8000)] + [(9900 + i, bad if i < 2 else good, "unlucky") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = host_rules.judge(docs).collect()
    assert {r.source for r in got if not r.base_failed and not r.kept} == {"poor"}
    assert all(r.host_bound < r.host_rate for r in got)


def test_equal_hashes_are_told_apart_by_words(spark, monkeypatch):
    """With a hash of four values only repeated words count."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(host_rules.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(4)))
    text = " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(10))
    got = host_rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_repeat_words == plain(text)[4]
