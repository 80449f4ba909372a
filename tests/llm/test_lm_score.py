import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from meridian.llm import lm_score

MEDIUM = "/root/testdata/sf0.01"


def plain(docs):
    def tokens(text):
        return [*re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]

    def fold(d):
        return None if d is None else zlib.crc32(str(d).encode()) % 7

    c = Counter(t for d, x in docs if fold(d) not in (None, 2) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for d, x in docs:
        own = tokens(x)
        yield d, len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own)


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "COUNTED", 5000)
    docs = pq.read_table(f"{MEDIUM}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = lm_score.query(spark, MEDIUM).collect()
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], list(plain(list(zip(docs["doc_id"], docs["text"], strict=True)))))
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in held)
    assert all(r.score < 0 for r in got)
    # the model explains unseen texts better than unigrams do
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_do_not_depend_on_the_broadcast_table(spark, monkeypatch):
    found = []
    for known in (1, 500, lm_score.KNOWN):
        monkeypatch.setattr(lm_score, "KNOWN", known)
        found.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in lm_score.query(spark, "/root/testdata/sf0.001").collect()})
    for other in found[:2]:
        assert other.keys() == found[2].keys()
        for doc, (n, base, score) in other.items():
            assert n == found[2][doc][0]
            assert math.isclose(base, found[2][doc][1], rel_tol=1e-9) and math.isclose(score, found[2][doc][2], rel_tol=1e-9)


SMALL = lm_score.Vocabulary.of([(b"a", 9), (b"b", 5), (b"c", 3), (b"d", 2), (b"e", 1)], classes=2, rare=2)
NAMES = "epguvbwa"


def small_net(**more):
    net = lm_score.Net(SMALL.begins, 3, counts=np.arange(SMALL.size), seed=4, **more)
    for name in NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    return net


def forward(net, text):
    """Log-likelihood of a coded text, code by code."""
    h, before, total = np.zeros(net.u.shape[1]), 0, 0.0
    n = len(h)
    for code in text:
        code = int(code)
        x, y = net.p.astype(float) @ net.e[before] + net.g[:, 0], net.u.astype(float) @ h
        z, r = (1 / (1 + np.exp(-(x[i : i + n] + y[i : i + n]))) for i in (0, n))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * y[2 * n :])
        kind = int(np.searchsorted(net.begins, code, side="right")) - 1
        logits = net.v @ h + net.b[:, 0]
        total += logits[kind] - np.log(np.exp(logits).sum())
        low, high = net.begins[kind], net.begins[kind + 1]
        logits = net.w[low:high] @ h + net.a[low:high, 0]
        total += logits[code - low] - np.log(np.exp(logits).sum())
        before = code
    return total


def test_gradients():
    net = small_net()
    draw = np.random.default_rng(2)
    target = draw.integers(0, SMALL.size, (6, 4))
    before = np.r_[np.zeros((1, 4), int), target[:-1]]
    start = draw.normal(size=(3, 4))

    def loss():
        h, total = start, 0.0
        for t in range(6):
            h = net.step(before[t], h * (before[t] != 0))[0]
            total -= net.log_likelihood(h, target[t]).sum()
        return total / target.size

    gradients, _ = net.window(before, target, start)
    for name, g in zip(NAMES, gradients, strict=True):
        w = getattr(net, name)
        for _ in range(6):
            i = tuple(draw.integers(0, s) for s in w.shape)
            w[i] += 1e-5
            up = loss()
            w[i] -= 2e-5
            down = loss()
            w[i] += 1e-5
            assert math.isclose((up - down) / 2e-5, g[i], rel_tol=1e-3, abs_tol=1e-7)


def test_scores_are_a_plain_forward_pass_in_any_company(monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    net = lm_score.Net(SMALL.begins, 16, counts=np.arange(SMALL.size))
    draw = np.random.default_rng(3)
    texts = [np.r_[draw.integers(1, SMALL.size, n), 0].astype(np.uint16) for n in (0, 1, 5, 31, 32, 33, 300, 7)]
    net.fit(np.concatenate(texts * 9), 0.02)
    want = [forward(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, rtol=1e-5)
    assert np.allclose([net.score([t])[0] for t in texts], want, rtol=1e-5)


def test_history_tells_words_of_a_class_apart():
    """a is followed by b, c by d; b and d are of one class."""
    vocabulary = lm_score.Vocabulary([b"a", b"c", b"b", b"d"], np.array([0, 1, 2, 3, 5, 6]), 1)
    net = lm_score.Net(vocabulary.begins)
    assert net.class_of[3] == net.class_of[4]
    one, two = np.array([1, 3, 0], np.uint16), np.array([2, 4, 0], np.uint16)
    net.fit(np.concatenate([one, two] * 4000), 0.05, 64)
    net.fit(np.concatenate([one, two] * 4000), 0.05, 64)
    right, wrong = net.score([one, two]).sum(), net.score([np.array([1, 4, 0], np.uint16), np.array([2, 3, 0], np.uint16)]).sum()
    assert right > wrong + 4


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 60_000)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").filter("length(text) < 20000")
    found = []
    for n in (1, 4, 32):
        model, counts, texts = lm_score.train(docs.repartition(n))
        found.append(sorted((r.doc_id, r.score) for r in lm_score.scores(texts, model, counts).collect()))
    for other in found[1:]:
        for (a, x), (b, y) in zip(found[0], other, strict=True):
            assert a == b and math.isclose(x, y, rel_tol=1e-6)


def test_model_is_a_distribution(spark):
    """Over all words of a rare class and one more for words not seen, probabilities add up to its share."""
    rows = [(i, "a a a b b c word%d other%d" % (i, i % 7)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts, _ = lm_score.train(docs)
    got = {bytes(r.word): r.n for r in counts.collect()}
    modelled = set(model.vocabulary.words)
    first = 1 + len(modelled)
    for k in range(model.vocabulary.rare):
        words = [w for w in got if w and w not in modelled and model.vocabulary.rare_code(w) == first + k]
        assert math.isclose(10 ** model.rare_weight[k], 1 + sum(got[w] + 1 for w in words))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Word word\tWORD"), (3, "Word word\tWORD"), (4, "word other"), (None, "word only here"), (5, "a b " * 20000), (6, "x" * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = lm_score.scores(*(lambda m, c, t: (t, m, c))(*lm_score.train(docs))).collect()
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], list(plain(rows)))
    none = docs.limit(0)
    model, counts, texts = lm_score.train(none)
    assert lm_score.scores(texts, model, counts).collect() == []
    assert len(lm_score.score(docs, model, counts).collect()) == len(rows)


def test_size_of_the_model():
    assert (lm_score.MODELLED, lm_score.WORD_CLASSES, lm_score.RARE_CLASSES, lm_score.HIDDEN) == (4096, 64, 16, 16)


def test_vocabulary_counts_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "MODELLED", 2)
    rows = [(i, "rare words here") for i in range(30)] + [(i, "long text " * 30000) for i in range(100, 130)]
    model, _, _ = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.vocabulary.words == [b"long", b"text"]


def test_every_token_of_a_stream_is_learned(monkeypatch):
    learned, window = [], lm_score.Net.window

    def spy(self, before, target, h, real=None):
        learned.extend(target[real].tolist())
        return window(self, before, target, h, real)

    monkeypatch.setattr(lm_score.Net, "window", spy)
    stream = np.random.default_rng(6).integers(0, SMALL.size, 64 * 40 + 39).astype(np.uint16)
    lm_score.Net(SMALL.begins).fit(stream, 0.01, 64)
    assert sorted(learned) == sorted(stream.tolist())


def test_filled_places_have_no_gradient():
    net, draw = small_net(), np.random.default_rng(2)
    target = draw.integers(1, SMALL.size, (6, 2))
    before, h = np.r_[np.zeros((1, 2), int), target[:-1]], np.zeros((3, 2))
    real = np.array([[True, False]] * 6)
    for a, b in zip(net.window(before, target, h, real)[0], net.window(before[:, :1], target[:, :1], h[:, :1])[0], strict=True):
        assert np.allclose(a, b, atol=1e-6)


def test_repeated_rows_and_long_words(spark):
    rows = [(1, "same words again")] * 500 + [(2, "x" * 100 + " " + "y" * 100), (3, "x" * 100)]
    docs = spark.createDataFrame(rows, "doc_id string, text string".replace("string", "long", 1))
    model, counts, texts = lm_score.train(docs)
    got = lm_score.scores(texts, model, counts).collect()
    assert len(got) == len(rows)
    assert len({(r.base_score, r.n_known) for r in got if r.doc_id == 1}) == 1
    assert max(len(r.word) for r in counts.collect()) <= 64
    named = docs.selectExpr("concat('n', doc_id) as doc_id", "text")
    model, counts, texts = lm_score.train(named)
    assert len(lm_score.scores(texts, model, counts).collect()) == len(rows)
