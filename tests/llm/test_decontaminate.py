import hashlib
import re

import duckdb
import pyarrow.parquet as pq

from meridian.llm import decontaminate

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add("null" if item is None else str(item))
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if items := wins.get(tuple(w[i : i + n])):
                    found |= items
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_query_against_brute_force(spark):
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    items = pq.read_table(f"{MEDIUM}/benchmark.parquet").to_pydict()
    want = plain(zip(docs["doc_id"], docs["text"], strict=True), list(zip(items["item_id"], items["text"], strict=True)))
    got = [tuple(r) for r in decontaminate.query(spark, MEDIUM).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[2] > 0 for r in got) > 0
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{MEDIUM}/{name}.parquet'")
    assert sorted(db.sql(decontaminate.SQL).fetchall()) == sorted(want)
    assert any(r[-1] for r in got)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, N_Hit string")
    b = spark.createDataFrame(items, "item_id long, text string, spans int")
    got = decontaminate.contained(d, b).collect()
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got), key=str)
    assert rows == sorted(plain([x[:2] for x in docs], [x[:2] for x in items]), key=str)


ODD_DOCS = [(1, None, "z"), (2, "", "z"), (3, "a b c d e f g h i j k l", None), (None, "A, B; c-d e f g h i j", None), (4, "hello", None), (5, "x y", None), (6, "x y x y x y", None), (6, "x y x y x y", None), (7, "ÀB é " * 20000 + "hello", None)]
ODD_ITEMS = [(1, "a b c d e f g h i j k", 1), (1, "a b c d e f g h i j k", 1), (2, "Hello!", 1), (3, "x y", None), (4, None, None), (5, "", None), (None, "Y x", None), (9, "àb é àb", None), (10, "B é Àb", None)]


def test_odd_rows(spark):
    check(spark, ODD_DOCS, ODD_ITEMS)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEWEST_BITS", 8)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 8)
    check(spark, ODD_DOCS, ODD_ITEMS)


def test_benchmark_as_large_as_the_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 1 << 10)
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    items = [(d["doc_id"], d["text"], None) for d in docs if d["doc_id"] % 2]
    check(spark, [(d["doc_id"], d["text"], None) for d in docs], items)


def test_equal_items_cost_their_number_only(spark):
    items = spark.createDataFrame([(i, "word", 0) for i in range(1000)], "item_id long, text string, n int")
    docs = spark.createDataFrame([(1, "word " * 1000)], "doc_id long, text string")
    row = decontaminate.contained(docs, items).first()
    assert (row.n_hit, len(row["items"]), [tuple(s) for s in row.spans]) == (1000, 1000, [(0, 1000)])


def test_empty_tables(spark):
    check(spark, ODD_DOCS, [])
    check(spark, [], ODD_ITEMS)
