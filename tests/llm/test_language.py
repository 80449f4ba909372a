import math
import zlib

import pyarrow.parquet as pq
import zstandard

from meridian.llm import language

MEDIUM = "/root/testdata/sf0.01"


def test_query_on_the_held_out_fold(spark):
    got = {r.doc_id: r for r in language.query(spark, MEDIUM).collect()}
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist()
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in held} == {k for k, r in got.items() if r.held_out}
    right = sum(got[d["doc_id"]].lang_pred == d["lang"] for d in held)
    assert right / len(held) > 0.96
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "es", "fr") for r in got.values())


TEXTS = {"en": "the quick brown fox and the lazy dog were in the house of the old man ", "de": "der schnelle braune fuchs und der faule hund waren in dem haus des alten mannes "}


def test_odd_rows(spark):
    rows = [(i, TEXTS[k] * 9, k) for i, k in enumerate(["en", "de"] * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 !?", "en"), (103, TEXTS["de"] * 2000, None), (104, TEXTS["en"], "en"), (104, TEXTS["en"], "en"), (None, "the man and the dog", None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, score int")
    model = language.train(docs)
    assert sorted(model) == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()]
    want = [(i, k) for i, k in enumerate(["en", "de"] * 20)] + [(100, "und"), (101, "und"), (102, "und"), (103, "de"), (104, "en"), (104, "en"), (None, "en")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    assert language.train(docs.limit(0)) == {} and language.identify(docs.limit(0), model).collect() == []


def test_narrow_margin_is_rejected():
    same = tuple((k, b"one two three " * 50) for k in ("aa", "bb"))
    assert language.predict("one two three four", same) == ("aa", 0.5, True)


def test_query_is_the_brute_force_prediction(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = tuple(sorted(language.train(docs).items()))
    texts = {r.doc_id: r.text for r in docs.filter("doc_id % 7 = 0").collect()}
    got = {r.doc_id: r for r in language.query(spark, MEDIUM).collect()}
    for d, t in texts.items():
        if not any(c.isalpha() for c in t or ""):
            want = ("und", 0.0)
        else:
            size = {}
            for name, content in model:
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size[name] = len(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False, level=language.LEVEL).compress(t.lower().encode() + bytes(64)))
            first, second = sorted(size.items(), key=lambda x: (x[1], x[0]))[:2]
            want = (first[0], 1 / (1 + math.exp(-min(30.0, (second[1] - first[1]) * math.log(2)))))
        assert got[d].lang_pred == want[0] and math.isclose(got[d].score, want[1], rel_tol=1e-9)


def test_many_languages_take_more_passes(spark, monkeypatch):
    rows = [(f"n{i}", TEXTS[k] * 9, k) for i, k in enumerate(["en", "de"] * 20)] + [(f"m{i}", f"word{i} " * 30, f"x{i:02}") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    whole = list(language.models_of(docs))
    assert len(whole) == 1
    want = sorted(map(tuple, language.identify(docs, *whole).collect()))
    monkeypatch.setattr(language, "TOGETHER", 2)
    parts = list(language.models_of(docs))
    assert len(parts) > 3
    assert sorted(map(tuple, language.identify(docs, *parts).collect())) == want


def test_repeated_ids_and_rare_languages_leave_other_dictionaries_alone(spark):
    rows = [(i, TEXTS[k] * 9 + str(i), k) for i, k in enumerate(["en", "de"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alone = language.train(docs)
    more = docs.union(spark.createDataFrame([(8, "again and again", "en")], docs.schema).crossJoin(spark.range(10000)).select(docs.columns))
    more = more.union(spark.createDataFrame([(1000, "un mot", "fr"), (1001, "un mot", "fr"), (1002, "un mot", "fr")], docs.schema))
    found = language.train(more)
    assert found["de"] == alone["de"] and len(found["fr"]) < 100
    assert found["en"].count(b"again and again") <= 1


def test_short_texts(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = tuple(sorted(language.train(docs).items()))
    held = [r for r in docs.filter("length(text) > 200 and lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    for n, least in ((60, 0.8), (120, 0.9)):
        right = [language.predict(r.text[:n], model)[0] == r.lang for r in held]
        assert sum(right) / len(right) > least


def test_dictionaries_hold_whole_texts_in_order_of_a_hash():
    assert language._part("Ab é", 5) == "ab é\n".encode()
    long = "é" * 10_000
    parts = {language._part(long, h) for h in range(1, 4000, 13)}
    assert all(len(p) <= language.WHOLE + 1 and p.decode() for p in parts)
    windows = {language._part("".join(chr(97 + k % 26) for k in range(40_000)), h)[:20] for h in range(0, 30_000, 777)}
    assert len(windows) > 10  # anywhere in the text


def test_no_id_is_left_out_for_its_order(spark):
    """Texts fill the dictionary by hash: both low and high ids are in it."""
    rows = [(i, f"word{i} " + "filler text of some length here " * 60, "en") for i in range(400)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ids = [int(w[4:]) for w in model["en"].decode().split() if w.startswith("word")]
    assert len(model["en"]) <= language.DICTIONARY and len(ids) > 40
    assert min(ids) < 100 and max(ids) > 300 and ids != sorted(ids)
    assert all(model["en"].decode().count(rows[i][1]) == 1 for i in ids)
    assert language.identify(spark.createDataFrame([("x " * 300_000,)], "text string"), model).first().lang_pred == "en"
