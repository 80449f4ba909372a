import hashlib
import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meridian.llm import chat

MEDIUM = "/root/testdata/sf0.01"
T = chat.Template()
PARTS = ["<", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_", "é", "日本", "😀", "\n", "a", "<\\|im_end|>", "[\\\\INST]", "s>", "", " "]


def odd_texts(n, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choices(PARTS, k=pick.randrange(9))) for _ in range(n)]


def plain(role, text):
    """A turn formatted without numpy: one more escape after the first character of a control string."""

    def escaped(x):
        out, i = "", 0
        while i < len(x):
            out += x[i]
            for c in T.controls:
                j = i + 1
                while j < len(x) and x[j] == T.escape:
                    j += 1
                if x[i] == c[0] and x.startswith(c[1:], j):
                    out += T.escape
                    break
            i += 1
        return out

    return T.begin + escaped(role) + T.separator + escaped(text) + T.end


def test_query_against_sql(spark):
    got = chat.query(spark, MEDIUM)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{MEDIUM}/conversations.parquet'")
    want = db.sql(chat.ORACLES["op12_chat"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_assembly_against_plain_python(monkeypatch):
    texts, roles = odd_texts(400), ["user", "assistant", "", "</s>", "a\nb"] * 80
    for window in (chat.WINDOW, 7):
        monkeypatch.setattr(chat, "WINDOW", window)
        buffer, ends, points, spans = chat.assemble(pa.array(roles), pa.array(texts), T)
        whole = buffer.to_pybytes()
        want = [plain(r, t) for r, t in zip(roles, texts, strict=True)]
        assert [whole[i:j].decode() for i, j in itertools.pairwise(ends.tolist())] == want
        assert points.tolist() == [0, *np.cumsum([len(x) for x in want]).tolist()]
        said = whole.decode()
        assert [T.unescape(said[i:j]) for i, j in spans.T.tolist()] == texts
    assert T.turns("".join(want)) == list(zip(roles, texts, strict=True))


def test_templates_that_could_not_be_read_back():
    for bad in ({"escape": "ab"}, {"others": ("<<SYS>>",)}, {"others": ("[INST]", "x[")}, {"escape": "<"}, {"begin": "é!"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    with pytest.raises(ValueError):
        T.turns("no marks")


def digests(rows):
    """rows (conv_id, turn, role, text), in order of turns, digested in Python."""
    out = {}
    for conv, _, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    found = []
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        found.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(plain(r, t)) for r, t in turns)))
    return sorted(found, key=str)


def rows_of(conv, texts):
    return [(conv, k, ("user", "assistant", None)[k % 3], t) for k, t in enumerate(texts)]


SCHEMA = "conv_id long, turn long, role string, text string, chunk string, whole int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_odd_rows(spark):
    rows = [*rows_of(1, odd_texts(30, 2)), *rows_of(None, ["a", None, "b"]), *rows_of(2, [None]), *rows_of(3, ["", "é" * 3_000_000, "<s>" * 1000]), (4, None, "assistant", "first"), (4, 0, "assistant", "second")]
    got = chat.digests(chat.format_chats(frame(spark, random.Random(3).sample(rows, len(rows))).repartition(5)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == digests(rows)
    again = chat.read_back(chat.format_chats(frame(spark, rows))).orderBy("conv_id", "part", "chunk", "position").collect()
    assert [(r.role, r.text) for r in again if r.conv_id == 1] == [(r or "", t) for _, _, r, t in rows_of(1, odd_texts(30, 2))]
    assert chat.digests(chat.format_chats(frame(spark, []))).collect() == []


def test_repeated_rows_are_repeated_turns(spark):
    rows = [(1, 0, "user", "u")] * 3 + [(1, 1, "assistant", "a")] * 2
    (row,) = chat.digests(chat.format_chats(frame(spark, rows))).collect()
    assert tuple(row) == digests(rows)[0]


def test_a_long_conversation_is_spread_and_digested_in_order(spark):
    """One conversation with most rows comes in several chunks of several tasks."""
    rows = [*rows_of(7, [f"turn {k} </s>" for k in range(20000)]), *rows_of(8, ["x", "y"])]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = chat.format_chats(frame(spark, rows).repartition(3))
        parts = made.filter("conv_id = 7").select("part").distinct().count()
        got = chat.digests(made).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert parts > 2
    assert sorted((tuple(r) for r in got), key=str) == digests(rows)
