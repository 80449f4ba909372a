import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from meridian.llm import phrases

MEDIUM = "/root/testdata/sf0.01"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_query_against_sql(spark):
    got = phrases.query(spark, MEDIUM)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{MEDIUM}/documents.parquet'")
    want = db.sql(phrases.ORACLES["op13_phrases"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, fewest, cover, top):
    """rows (lang, text) mined in Python."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        mine = counts.setdefault(lang, Counter())
        for ws in pieces(text):
            sizes[lang] += len(ws)
            mine.update(tuple(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= fewest}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= cover * a for q, b in found.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(lang, t, 5, "x") for lang, t in rows], "lang string, text string, rank long, score string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **how).select(*COLUMNS).collect())


def texts(n, seed):
    pick = random.Random(seed)
    words = ["New", "york", "city", "É", "日本", "a", "b", "c", "\x00", "x" * 40, "-", "the"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", " ", " ", "\x85", " "]
    return [(pick.choice(["en", "fr", None, "und", "EN"]), "".join(pick.choice(words) + pick.choice(ends) for _ in range(pick.randrange(60)))) for _ in range(n)]


def test_odd_texts_against_plain_python(spark):
    rows = texts(300, 4) + [("en", None), ("en", ""), (None, None), ("en", " \t\n.,"), ("en", "new york city " * 400), ("long", "z" * 2_500_000 + " a b " + "z" * 2_500_000 + " a b")] + texts(5, 4) * 3
    for how in ({"fewest": 10, "cover": 50, "top": 2000}, {"fewest": 2, "cover": 90, "top": 40}):
        assert mined(spark, rows, **how) == plain(rows, **how)


def test_several_tries_count_alike(spark, monkeypatch):
    rows = texts(200, 8)
    monkeypatch.setattr(phrases, "TRIE", 60)
    assert mined(spark, rows, fewest=3) == plain(rows, 3, 50, 2000)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), ("en", "once only")]) == []


def test_scores_past_64_bits(spark):
    a, f = 3_000_000_000, 4_000_000_000
    words = spark.createDataFrame([(1, "en", "x", f), (2, "en", "y", f + 1)], "h long, lang string, word string, f long")
    counted = spark.createDataFrame([(1, 2, 0, a)], "h1 long, h2 long, h3 long, a long")
    (row,) = phrases.ranked(counted, words, words.groupBy("lang").agg({"f": "sum"}).withColumnRenamed("sum(f)", "n"), 50, 10).collect()
    assert (row.score, row.l, row.r) == (1000000 * a * a // (f * (f + 1)), f, f + 1)


def test_windows_of_any_size_give_the_same_words(monkeypatch):
    rows = [t for _, t in texts(40, 6)] + ["", "x" * 500, "a." * 50, "ab cd"]
    column = pa.array(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), column], names=["lang", "text"])

    def grams():
        found = Counter()
        for _, _, w in phrases.Hasher(0).batch(batch):
            for i in range(w.new, len(w.hashes)):
                found[(w.hashes[i],)] += 1
                if i and not w.breaks[i]:
                    found[(w.hashes[i - 1], w.hashes[i])] += 1
                    if i > 1 and not w.breaks[i - 1]:
                        found[(w.hashes[i - 2], w.hashes[i - 1], w.hashes[i])] += 1
        return sorted(found.values())

    want = Counter()
    for t in rows:
        for ws in pieces(t):
            want.update(tuple(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    for window in (1 << 20, 64, 11):
        monkeypatch.setattr(phrases, "WINDOW", window)
        assert grams() == sorted(want.values())


def test_trie_knows_its_phrases_and_no_others():
    draw = np.random.default_rng(5)
    words = draw.integers(1, 1 << 63, 5000).astype(np.uint64)
    rows = words[draw.integers(0, len(words), (3, 20000))]
    rows[:, :4000][0] = words[0]  # a word with very many followers
    rows[2, ::3] = 0
    rows = np.unique(rows, axis=1)
    trie = phrases.Trie(rows)
    first = rows.T
    hashes = np.concatenate([r[r != 0] for r in first])
    sizes = np.count_nonzero(first, axis=1)
    breaks = np.zeros(len(hashes), bool)
    breaks[np.cumsum(sizes) - sizes] = True
    counts = np.zeros(rows.shape[1], np.int64)
    trie.count(phrases.Words(hashes, breaks, 0, None, None, None), counts)
    known = {tuple(r): i for i, r in enumerate(first.tolist())}
    want = np.zeros(rows.shape[1], np.int64)
    for r, n in zip(first.tolist(), sizes, strict=True):
        for part in ([*r[:2], 0], [*r[1:], 0], r) if n == 3 else (r,):
            if tuple(part) in known:
                want[known[tuple(part)]] += 1
    assert (counts == want).all()


def test_passes_over_the_texts_do_not_grow_with_the_candidates(spark, monkeypatch):
    """However many tries the candidates take, texts are hashed by four kinds of tasks and no trie is sent to all."""
    rows, passes, sent = texts(200, 8), [], []
    frame, send = type(spark.range(0)), type(spark.sparkContext).broadcast
    found = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: passes.append(f) or found(self, f, *a, **b))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(type(x)) or send(self, x))
    for trie in (1 << 19, 7):
        monkeypatch.setattr(phrases, "TRIE", trie)
        assert mined(spark, rows, fewest=2) == plain(rows, 2, 50, 2000)
    assert len(passes) == 8 and set(sent) == {np.ndarray}


def test_places_are_counted_by_how_often_they_were_seen():
    draw = np.random.default_rng(7)
    words = draw.integers(1, 1 << 63, 300).astype(np.uint64)
    places = words[draw.integers(0, len(words), (3, 9000))]
    places[2, ::2] = 0
    n = draw.integers(1, 1 << 32, 9000).astype(np.uint32)
    different = phrases._different(places)
    known = different[:, ::3]
    want = {tuple(p): 0 for p in known.T.tolist()}
    for p, k in zip(places.T.tolist(), n.tolist(), strict=True):
        if tuple(p) in want:
            want[tuple(p)] += k
    assert phrases.Trie(known).count_places(places, n).tolist() == list(want.values())
