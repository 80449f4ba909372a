import glob
import gzip
import hashlib

import duckdb

from meridian.llm import warc

MEDIUM = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    got = sorted(tuple(r) for r in warc.query(spark, MEDIUM).collect())
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{MEDIUM}/pages.parquet'")
    assert got == sorted(db.sql(warc.SQL).fetchall())


LONG = "<html>é\r\n\r\nWARC/1.1\r\n\n\n" + "x" * 100
ROWS = [
    (7, "http://a/\r\nX: y", LONG), (5, "u", LONG), (9, None, LONG), (5, "u", LONG), (None, "u", LONG), (1, "u", None), (2, "u", ""), (3, "u", "short"), (4, "u", "short"),
    (10, "u", "\r\n" * 60), (11, "u", "\r\n" * 60), (12, "u", "ends in break\r\n\r\n" + "y" * 100 + "\r\n\r\n"), (13, "u", "é" * 300000), (14, "u", "z" * 99 + "\n"), (15, "u", "z" * 99),
]


def plain(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, d in data:
        ids = [q for q, e in data if e == d and q is not None]
        first = min(ids, default=None)
        revisit = len(d) >= 100 and first is not None and p != first
        out.append((p, len(d), hashlib.sha256(d).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, refers_to string")
    path = str(tmp_path / "w")
    got = warc.archived(pages.coalesce(2), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)
    whole = b"".join(gzip.open(p).read() for p in glob.glob(path + "/*.gz"))
    assert whole.count(b"WARC-Type: revisit\r\n") == sum(r[3] == "revisit" for r in plain(ROWS))
    assert whole.count(LONG.encode()) == 2  # both rows of the smallest id


def test_archive_is_cut_by_length_alone(spark, tmp_path):
    body = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    with gzip.open(tmp_path / "a.txt.gz", "wb") as out:
        out.write((head + body + b"\r\n\r\n") * 2)
    assert [r.page_id for r in warc.read_archives(spark, str(tmp_path)).collect()] == [3, 3]


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_many_repeated_digests_go_by_a_bitmap(spark, tmp_path, monkeypatch):
    """Beyond the broadcast bound the results are the same, and no page without copies is shuffled with its payload."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, refers_to string")
    got = warc.archived(pages.coalesce(2), str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)
    rows = [(k, "u", f"page {k // 2 if k < 400 else k} " + "x" * 100) for k in range(4000)]
    flagged = warc.resolved(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert flagged.filter("refers_to is not null").count() == 200
    headed = spark.createDataFrame([(hashlib.sha256(h.encode()).hexdigest(),) for _, _, h in rows], "payload_digest string")
    repeats = headed.groupBy("payload_digest").count().filter("count > 1")
    marked = warc._marked(headed, repeats, repeats.count())
    assert 400 <= marked.filter("maybe").count() < 900
    assert marked.join(repeats, "payload_digest").filter("not maybe").count() == 0


def test_ids_of_any_type_and_clashing_columns(spark):
    body = "z" * 200
    rows = [("b/ü <x>\n", "u", body, "k", 1), ("a b", "u", body, "k", 1), ("", "u", "short", "k", 1), (None, "u", body, "k", 1)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, payload string, original int")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archived(pages).collect()}
    assert got == {("a b", "response", None), ("b/ü <x>\n", "revisit", "a b"), (None, "response", None), (None, "revisit", "a b")}
