import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from meridian.llm import bpe

MEDIUM = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts, bpe.encoder(PATH))]


def test_query_against_library(spark, library):
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = []
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        tokens = library.encode_ordinary(t or "")
        want.append((d, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r)[:4] for r in bpe.query(spark, MEDIUM).collect()]
    assert sorted(got) == sorted(want)


def test_odd_texts(library):
    draw = random.Random(3)
    alphabet = "a b's'll 've'd''re \n\t 12é漢字!?.　\xa0Z𝟙'"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(5000)]
    texts += ["".join(chr(draw.choice([draw.randint(1, 0xD7FF), draw.randint(0xE000, 0x10FFFF), draw.randint(32, 600)])) for _ in range(30)) for _ in range(5000)]
    texts += ["", " ", "'", "'s", "ab" * 30000 + " " + "x!" * 1000 + " " * 5000, "<|endoftext|>", *(chr(c) + "'re" for low, high, _ in bpe.ADDED for c in (low, high))]
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]


def test_cache_of_two_generations(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    monkeypatch.setattr(bpe, "SCAN", 50)
    own = bpe.Encoder(PATH)
    texts = [f"wordy{i} thing{i % 7} {i}" for i in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts, own)] == [library.encode_ordinary(t) for t in texts]
    assert len(own) + len(own.old) < 100


def test_rows_offsets_and_round_trip(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Héllo  wörld's\n", "x"), (3, "Héllo  wörld's\n", "x"), (None, "𝟙 漢字" * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded.decode()) for r in got) == sorted((str(d), t or "") for d, t, _ in rows)
    for r in got:
        ends = np.frombuffer(r.token_ends, "<u4").tolist()
        pieces = {v: k for k, v in bpe.vocabulary(PATH).items()}
        tokens = np.frombuffer(r.token_ids, "<u4").tolist()
        data = (r.text or "").encode()
        assert [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [pieces[t] for t in tokens]
    assert bpe.encode(docs.limit(0), PATH).collect() == []
