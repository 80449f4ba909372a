import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tokenizers

from meridian.llm import token_counts

MEDIUM = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def plain(library, docs):
    out = []
    for d, t in docs:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        out.append((d, len((t or "").encode()), n, n > 2048))
    return sorted(out, key=str)


def test_query_against_library(spark, library):
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted((tuple(r) for r in token_counts.query(spark, MEDIUM).collect()), key=str)
    assert got == plain(library, zip(docs["doc_id"], docs["text"], strict=True))


def test_odd_texts(library):
    draw = random.Random(7)
    own = token_counts.counting(PATH)
    alphabet = ["a", "B", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'LL", "İ", "Σ", "ΣΑΣ", "é", "é", "²", "½", "Ⅷ", "漢", "12", "?!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", "​", "ſ", "K", "ǅ", "_", "ꟍ", "𝟙", "한", "가", "ß", "ẞ"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(draw.choice([draw.randint(1, 0xD7FF), draw.randint(0xE000, 0x10FFFF), draw.randint(32, 600), draw.randint(0x300, 0x530)])) for _ in range(20)) for _ in range(4000)]
    texts += ["".join(chr(draw.randint(1, 0x24F)) for _ in range(30)) for _ in range(4000)]
    for t in texts:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), ascii(t)


def test_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "SAMPLE", 3)
    rows = [(1, None), (2, ""), (3, "Hello hello <|endoftext|>"), (3, "Hello hello <|endoftext|>"), (None, "naïve " * 30000), (5, "x" * 50000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in token_counts.count_tokens(docs, PATH).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert sorted(got, key=str) == plain(library, rows)
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_newer_code_points_go_through_the_table(spark, library, monkeypatch):
    emoji = ["\U0001f600", "\U0001f9d1\u200d\U0001f4bb", "\U0001fae0!", "a\U0001f600b", "x\x1cy"]
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["plain", "words", "naïve", "it's", *emoji]) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in token_counts.count_tokens(docs, PATH).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert sorted(got, key=str) == plain(library, rows)
    assert {"plain", "words", "naïve"} <= {p for p, _ in token_counts.frequent(docs, PATH)}
    own, asked = token_counts.Counting(PATH), []
    monkeypatch.setattr(own, "by_library", lambda w: asked.append(w) or 0)
    for _, t in rows:
        own.count(t)
    assert asked and all(w in emoji for w in asked)


def test_no_pre_token_is_shuffled(spark, monkeypatch):
    import contextlib
    import io

    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        token_counts.count_tokens(docs, PATH).explain("formatted")
    assert "Exchange" not in shown.getvalue()
