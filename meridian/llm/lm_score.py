"""Scores by a gated recurrent language model with a class-factored output softmax.

A word's probability is P(its class | all before it) * P(word | class, all before it). Both
factors are softmaxes over the state of a gated recurrent net that reads the words
themselves. The net is trained in numpy by truncated backpropagation; its state is carried
across windows, so a text is scored whole.

The net's vocabulary are the MODELLED most frequent words of all training documents, in
WORD_CLASSES classes cut by frequency (equal shares of the square roots of counts). Every
other word is one of RARE_CLASSES classes by its ending; the net gives that class, and
within it a word has the share (c+1) / (sum of all c+1 there, and 1 for words not seen).

Counts come from all training documents and stay a distributed table. The most frequent
words (at most KNOWN) are broadcast; counts of other words reach the documents by a join.
A word of more than WORD_BYTES bytes goes by its digest, which bounds what is broadcast to
about 20 MB.

The net learns from all training documents, each once. They are dealt by a hash of id and
text to shards of about SHARD tokens (so the number of shards grows with the corpus, and
depends on nothing else). In each of ROUNDS rounds every shard goes on from the common net
through its part of the documents, in order of that hash, and the shards' weights are
averaged by their tokens. So scores don't depend on how the table is partitioned.
"""

from __future__ import annotations

import copy
import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, fresh, stored, table, text_bytes, with_columns

FOLDS, HELD_OUT = 7, 2
KNOWN, WORD_BYTES = 1 << 18, 64
#: distinct words that a task counts before it hands them on
COUNTED = 300_000
MODELLED, WORD_CLASSES, RARE_CLASSES = 4096, 64, 16
HIDDEN, WINDOW, STREAMS = 16, 32, 512
#: states whose outputs are computed together
BLOCK = 1024
SHARD, ROUNDS = 4_000_000, 2
#: learning rate of each round
RATES = (0.03, 0.015)
#: tokens that a task holds at once: side by side, long texts don't run alone
HELD = 2_000_000
#: averaged weights are summed as whole numbers of this, so the order of shards doesn't show
GRAIN = 2.0**-20
#: pieces that the weights are summed in
PIECES = 16
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: the token that ends a text (no word is empty), and its code
END, END_CODE = b"", 0


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; one of more than WORD_BYTES bytes as a space (no word has one) and its digest."""
    words = text.translate(FOLD).split()
    if len(text) > WORD_BYTES and max(map(len, words), default=0) > WORD_BYTES:
        return [w if len(w) <= WORD_BYTES else b" " + hashlib.sha256(w).digest() for w in words]
    return words


@dataclass
class Vocabulary:
    """Codes: 0 is the end of a text, then the modelled words, most frequent first, then the rare classes."""

    words: list[bytes]
    #: first code of each class, and one past the last; rare classes and the end hold one code each
    begins: np.ndarray
    rare: int = RARE_CLASSES

    @classmethod
    def of(cls, counted: list[tuple[bytes, int]], classes: int = WORD_CLASSES, rare: int = RARE_CLASSES) -> Vocabulary:
        """From the words to model with their counts, most frequent first."""
        n = len(counted)
        share = np.cumsum(np.sqrt(np.array([c for _, c in counted], float)))
        cuts = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes) if n else np.zeros(0, np.int64)
        begins = np.unique(np.r_[0, 1, 1 + cuts, 1 + n + np.arange(rare + 1)])
        return cls([w for w, _ in counted], begins, rare)

    @property
    def size(self) -> int:
        return 1 + len(self.words) + self.rare

    def rare_code(self, word: bytes) -> int:
        return 1 + len(self.words) + zlib.crc32(word[-3:]) % self.rare


class Net:
    """The recurrent net over a vocabulary's codes. Arrays of states hold a column for each text."""

    def __init__(self, begins: np.ndarray, hidden: int = HIDDEN, counts: np.ndarray | None = None, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.begins = np.asarray(begins, np.int64)
        codes, classes = int(self.begins[-1]), len(self.begins) - 1
        self.class_of = np.repeat(np.arange(classes), np.diff(self.begins))

        def drawn(spread: float, *shape: int) -> np.ndarray:
            return draw.normal(0, spread, shape).astype(np.float32)

        #: what a code adds to the gates: its embedding, times p, and g
        self.e, self.p, self.g = drawn(0.3, codes, hidden), drawn(0.3, 3 * hidden, hidden), np.zeros((3 * hidden, 1), np.float32)
        self.u = drawn(0.2, 3 * hidden, hidden)
        #: outputs of classes, and of the codes in them
        self.v, self.b = drawn(0.1, classes, hidden), np.zeros((classes, 1), np.float32)
        self.w, self.a = drawn(0.1, codes, hidden), np.zeros((codes, 1), np.float32)
        if counts is not None:  # begin as unigrams
            some = np.asarray(counts, float) + 1
            self.a[:, 0] = np.maximum(np.log(some / some.max()), -16)
            some = np.add.reduceat(some, self.begins[:-1])
            self.b[:, 0] = np.maximum(np.log(some / some.max()), -16)

    def weights(self) -> list[np.ndarray]:
        return [self.e, self.p, self.g, self.u, self.v, self.b, self.w, self.a]

    def step(self, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state after reading the codes before, and what backpropagation needs."""
        n = len(h)
        gx = self.p @ self.e[before].T
        gx += self.g
        gh = self.u @ h
        gates = gx[: 2 * n]
        gates += gh[: 2 * n]
        gates *= 0.5  # the logistic function by tanh
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r, inner = gates[:n], gates[n:], gh[2 * n :]
        new = r * inner
        new += gx[2 * n :]
        np.tanh(new, out=new)
        found = h - new
        found *= z
        found += new
        return found, z, r, inner, new

    def _sorted(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Order of the targets by code, and (begin, end, first code, end) of each class of two codes or more."""
        order = np.argsort(target.astype(np.uint16), kind="stable")
        edges = np.searchsorted(target[order], self.begins)
        some = np.flatnonzero((edges[1:] > edges[:-1]) & (np.diff(self.begins) > 1))
        return order, [(int(edges[k]), int(edges[k + 1]), int(self.begins[k]), int(self.begins[k + 1])) for k in some]

    def log_likelihood(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target code) after each state; clipped weights and states within -1..1 keep exp() finite."""
        kind, out = self.class_of[target], np.empty(len(target))
        for at in range(0, len(target), BLOCK):
            found = self.v @ states[:, at : at + BLOCK]
            found += self.b
            own = found[kind[at : at + BLOCK], np.arange(found.shape[1])]
            out[at : at + BLOCK] = own - np.log(np.exp(found, out=found).sum(axis=0))
        order, parts = self._sorted(target)
        states, target = states[:, order], target[order]
        for i, j, low, high in parts:
            found = self.w[low:high] @ states[:, i:j]
            found += self.a[low:high]
            own = found[target[i:j] - low, np.arange(j - i)]
            out[order[i:j]] += own - np.log(np.exp(found, out=found).sum(axis=0))
        return out

    def fit(self, stream: np.ndarray, rate: float, rows: int = STREAMS) -> None:
        """Truncated backpropagation, once through a stream of coded texts, each ended by END_CODE."""
        rows = min(rows, max(1, len(stream) // WINDOW))
        length = -(-len(stream) // rows)
        if not length:
            return
        # filled up to whole rows; what fills isn't learned
        target = np.append(stream, np.full(rows * length - len(stream), END_CODE, stream.dtype)).reshape(rows, length).T.astype(np.int64)
        real = (np.arange(target.size) < len(stream)).reshape(rows, length).T
        before = np.r_[np.full((1, rows), END_CODE), target[:-1]]
        before[0, 1:] = target[-1, :-1]
        weights = self.weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        h = np.zeros((self.u.shape[1], rows), np.float32)
        total, most = math.ceil(length / WINDOW), 64 / self.u.shape[1]
        for done, at in enumerate(range(0, length, WINDOW), 1):
            gradients, h = self.window(before[at : at + WINDOW], target[at : at + WINDOW], h, real[at : at + WINDOW])
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in gradients))
            size = np.float32(rate * (1 - 0.8 * done / total) * math.sqrt(1 - 0.99**done) / (1 - 0.9**done))
            scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            for w, g, a, b in zip(weights, gradients, first, second, strict=True):
                g *= scale
                a *= np.float32(0.9)
                a += np.float32(0.1) * g
                g *= g
                b *= np.float32(0.99)
                b += np.float32(0.01) * g
                np.sqrt(b, out=g)
                g += np.float32(1e-7)
                np.divide(a, g, out=g)
                g *= size
                w -= g
            for w, bound in ((self.v, most), (self.w, most), (self.b, 16), (self.a, 16)):
                np.clip(w, -bound, bound, out=w)

    def window(self, before: np.ndarray, target: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the mean loss over a window's real targets (all by default), and the state after it.

        before and target: codes, a row for each step.
        """
        (steps, rows), n = before.shape, len(h)
        keeps = (before != END_CODE).astype(h.dtype)
        kept = []
        for t in range(steps):
            start = h * keeps[t]
            h, *rest = self.step(before[t], start)
            kept.append((start, h, *rest))
        states, goal = np.concatenate([k[1] for k in kept], axis=1), target.ravel()
        whole = real is None or bool(real.all())
        share = np.full(len(goal), 1 / len(goal), h.dtype) if whole else (real.ravel() / max(1, real.sum())).astype(h.dtype)
        kind, dstates = self.class_of[goal], np.empty_like(states)
        dv, db, dw, da = (np.zeros_like(x) for x in (self.v, self.b, self.w, self.a))
        for at in range(0, len(goal), BLOCK):
            own, mine = states[:, at : at + BLOCK], share[at : at + BLOCK]
            flat = self.v @ own
            flat += self.b
            np.exp(flat, out=flat)
            flat *= mine / flat.sum(axis=0)
            flat[kind[at : at + BLOCK], np.arange(len(mine))] -= mine
            dv += flat @ own.T
            db += flat.sum(axis=1, keepdims=True)
            dstates[:, at : at + BLOCK] = self.v.T @ flat
        order, parts = self._sorted(goal)
        sorted_states, goal, share, more = states[:, order], goal[order], share[order], np.zeros_like(states)
        for i, j, low, high in parts:
            own, mine = sorted_states[:, i:j], share[i:j]
            flat = self.w[low:high] @ own
            flat += self.a[low:high]
            np.exp(flat, out=flat)
            flat *= mine / flat.sum(axis=0)
            flat[goal[i:j] - low, np.arange(j - i)] -= mine
            dw[low:high], da[low:high] = flat @ own.T, flat.sum(axis=1, keepdims=True)
            more[:, i:j] = self.w[low:high].T @ flat
        dstates[:, order] += more
        dp, dg, du, later = np.zeros_like(self.p), np.zeros_like(self.g), np.zeros_like(self.u), np.zeros_like(h)
        inputs = np.empty((steps, rows, n), h.dtype)
        gates = np.empty((3 * n, rows), h.dtype)
        for t in range(steps - 1, -1, -1):
            start, _, z, r, inner, new = kept[t]
            dh = dstates[:, t * rows : (t + 1) * rows] + later
            dnew = dh * (1 - z)
            dnew *= 1 - new * new
            gates[:n] = dh * (start - new) * (z * (1 - z))
            gates[n : 2 * n] = dnew * inner * (r * (1 - r))
            gates[2 * n :] = dnew
            dp += gates @ self.e[before[t]]
            dg += gates.sum(axis=1, keepdims=True)
            inputs[t] = gates.T @ self.p
            gates[2 * n :] *= r
            du += gates @ start.T
            later = self.u.T @ gates
            later += dh * z
            later *= keeps[t]
        read = before.ravel().astype(np.uint16)
        order = np.argsort(read, kind="stable")
        codes, begin = np.unique(read[order], return_index=True)
        de = np.zeros_like(self.e)
        de[codes] = np.add.reduceat(inputs.reshape(-1, n)[order], begin)
        return [de, dp, dg, du, dv, db, dw, da], h

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of the codes of each whole text (each ends in END_CODE)."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        total, h = np.zeros(len(texts)), np.zeros((self.u.shape[1], len(texts)), np.float32)
        before = np.full(len(texts), END_CODE)
        states: list[np.ndarray] = []
        targets: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size, longest = 0, int(sizes.max(initial=0))
        for t in range(longest):
            n = int(np.searchsorted(-sizes[: len(before)], -t))  # texts longer than t
            h, before = self.step(before[:n], np.ascontiguousarray(h[:, :n]))[0], flat[begin[:n] + t]
            states.append(h)
            targets.append(before)
            owners.append(np.arange(n))
            size += n
            if size >= 4 * BLOCK or t == longest - 1:
                logs = self.log_likelihood(np.concatenate(states, axis=1), np.concatenate(targets))
                total += np.bincount(np.concatenate(owners), logs, len(total))
                states, targets, owners, size = [], [], [], 0
        out = np.empty(len(texts))
        out[order] = total
        return out


@dataclass
class Model:
    tokens: int
    distinct: int
    vocabulary: Vocabulary
    known: list[tuple[bytes, int]]
    #: log10 of a rare class's counts, with one for each distinct word and one for words not seen
    rare_weight: np.ndarray
    net: Net


def count_words(training: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n): counts of words, and of the ends of texts (the empty word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in chunks(batches, text):
            for t in text_bytes(batch, text):
                seen.update(words_of(t))
            seen[END] += batch.num_rows
            if len(seen) > COUNTED:
                yield counted()
                seen.clear()
        yield counted()

    return training.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _modelled(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The words that the net tells apart: the most frequent in the whole table of counts."""
    top = counts.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(MODELLED).collect()
    return [(bytes(r.word), r.n) for r in top]


def _known(counts: DataFrame) -> list[tuple[bytes, int]]:
    """Words with a count over a threshold that at most KNOWN words reach, most frequent first."""
    level = F.floor(F.log2("n") * 16)
    words = counts.filter(F.length("word") > 0)
    room, least = KNOWN, None
    for found, n in sorted(map(tuple, words.groupBy(level.alias("level")).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = found
    if least is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in words.filter(level >= least).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


def _rare_counts(counts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each rare class, and tokens + distinct words + 1, over the whole table of counts."""
    first, modelled = 1 + len(vocabulary.words), set(vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((vocabulary.rare, 2), np.int64)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w and w not in modelled:
                    total[vocabulary.rare_code(w) - first] += (n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(vocabulary.rare, dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["at", "n", "words"])

    tokens, weight = np.zeros(vocabulary.rare), np.ones(vocabulary.rare)
    rows = counts.select("word", "n").mapInArrow(run, "at int, n long, words long").groupBy("at").agg(F.sum("n"), F.sum("words"))
    for at, n, words in rows.collect():
        tokens[at] = n
        weight[at] += n + words
    return tokens, weight


def coded(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: row (number), the id, n_tokens, n_known, known_sum, part_sum, rare, codes, h, learn.

    codes are the text's as little-endian uint16, the end included. known_sum adds up
    log10(c+1) of the words found in the broadcast table and of the end; part_sum does so
    for those outside the net's vocabulary, less rare_weight of all words outside it. rare
    lists the words found nowhere in that table. h is the hash that deals out the shards;
    learn is false in the held-out fold and where there is no id.
    """
    rest = docs.select(doc_id, text, F.xxhash64(doc_id, text).alias("h"), F.coalesce(crc_mod(doc_id, FOLDS) != HELD_OUT, F.lit(False)).alias("learn"))
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.known, model.rare_weight))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, rare_weight = shared.value
        first = 1 + len(vocabulary.words)
        place = {w: i for i, (w, _) in enumerate(known)}
        log_count = np.log10(np.array([n for _, n in known] or [0], np.float64) + 1)
        has = np.array([n > 0 for _, n in known] or [False])
        own_code = {w: 1 + i for i, w in enumerate(vocabulary.words)}
        code = np.array([own_code.get(w, 0) or (vocabulary.rare_code(w) if w else END_CODE) for w, _ in known] or [0], np.uint16)
        get, row = place.get, TaskContext.get().partitionId() << 33
        for batch in chunks(batches, text):
            columns: list[list] = [[] for _ in range(6)]
            for t in text_bytes(batch, text):
                words = words_of(t)
                words.append(END)
                at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                codes = code[at]
                missed = np.flatnonzero(at < 0)
                left = [words[i] for i in missed.tolist()]
                if left:
                    codes[missed] = [own_code.get(w, 0) or vocabulary.rare_code(w) for w in left]
                    found = at[at >= 0]
                else:
                    found = at
                logs = log_count[found]
                part = float(logs[code[found] >= first].sum()) - float(rare_weight[codes[codes >= first] - first].sum())
                columns[0].append(len(words))
                columns[1].append(int(has[found].sum()))
                columns[2].append(float(logs.sum()))
                columns[3].append(part)
                columns[4].append([{"word": w, "times": n, "other": w not in own_code} for w, n in Counter(left).items()])
                columns[5].append(codes.astype("<u2").tobytes())
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64()), ("other", pa.bool_())])), pa.binary()]
            arrays = [pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(2), batch.column(3)]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(arrays, names=["row", doc_id, "n_tokens", "n_known", "known_sum", "part_sum", "rare", "codes", "h", "learn"])

    schema = f"row long, `{doc_id}` {kind}, n_tokens long, n_known long, known_sum double, part_sum double, "
    schema += "rare array<struct<word:binary,times:bigint,other:boolean>>, codes binary, h long, learn boolean"
    # rows get numbers that stay, as the table is written
    return stored(rest.mapInArrow(run, schema), "coded")


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, n binary): the sums of arrays of int64, streamed in order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in at), pa.array([total.tobytes()], pa.binary())], names=[*keys, "n"])

        for batch in batches:
            for *key, data in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if key != at:
                    if at is not None:
                        yield out()
                    at, total = key, np.frombuffer(data, "<i8").copy()
                else:
                    total += np.frombuffer(data, "<i8")
        if at is not None:
            yield out()

    return parts.select(*keys, "n").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join([*(f"{k} int" for k in keys), "n binary"]))


def learn(texts: DataFrame, net: Net, shards: int, rate: float) -> Net:
    """The mean net of all shards, each gone once through its texts (codes, h); net itself without texts.

    Rows with equal id and text are neighbours in a shard and are learned from once there.
    """
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, held, size, total, last = None, None, [], 0, 0, None

        def fit() -> None:
            nonlocal held, size, total
            own.fit(np.frombuffer(b"".join(held), "<u2"), rate)
            held, size, total = [], 0, total + size

        def out() -> Iterator[pa.RecordBatch]:
            fit()
            flat = np.append(np.concatenate([w.ravel() for w in own.weights()]).astype(np.float64), 1.0)
            whole = np.rint(flat / GRAIN).astype("<i8") * total
            for i, part in enumerate(np.array_split(whole, PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([shard % 64], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["piece", "bucket", "n"])

        for batch in batches:
            for number, h, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number != shard:
                    if shard is not None:
                        yield from out()
                    shard, own, total, last = number, copy.deepcopy(shared.value), 0, None
                if (h, data) == last:
                    continue
                last = (h, data)
                held.append(data)
                size += len(data) // 2
                if size >= SHARD:
                    fit()
        if shard is not None:
            yield from out()

    dealt = texts.select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "codes").repartition(shards, "shard").sortWithinPartitions("shard", "h", "codes")
    sums = _added(_added(dealt.mapInArrow(run, "piece int, bucket int, n binary"), "piece", "bucket"), "piece").orderBy("piece").collect()
    flat = np.concatenate([np.frombuffer(r.n, "<i8") for r in sums]) if sums else np.zeros(0)
    if not len(flat) or not flat[-1]:
        return net
    out, at = copy.deepcopy(net), 0
    for w in out.weights():
        w.ravel()[:] = flat[at : at + w.size] / flat[-1]
        at += w.size
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table of counts, and docs as coded, from the documents outside the held-out fold.

    Documents without an id belong to no fold and aren't learned from. Null texts are
    empty: only their end is counted.
    """
    counts = stored(count_words(docs.filter(crc_mod(doc_id, FOLDS) != HELD_OUT), text), "counts")
    tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
    top = _modelled(counts)
    vocabulary = Vocabulary.of(top)
    rare, weight = _rare_counts(counts, vocabulary)
    net = Net(vocabulary.begins, counts=np.r_[ends, [n for _, n in top], rare])
    model = Model(tokens, distinct, vocabulary, [(END, ends), *_known(counts)], np.log10(weight), net)
    texts = coded(docs, model, doc_id, text)
    shards = max(1, math.ceil(tokens / SHARD))
    for k in range(ROUNDS):
        turn = F.pmod(F.shiftright("h", 32), F.lit(ROUNDS)) == k
        model.net = learn(texts.filter(F.col("learn") & turn), model.net, shards, RATES[k])
    return model, counts, texts


def likely(texts: DataFrame, net: Net) -> DataFrame:
    """texts with ``likely``: the net's log10 probability of the codes, instead of the codes."""
    shared = texts.sparkSession.sparkContext.broadcast(net)
    rest = fresh(texts, "likely")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            codes = [np.frombuffer(c, "<u2") for b in waiting for c in b.column(b.schema.get_field_index("codes")).to_pylist()]
            found, at = shared.value.score(codes) / math.log(10), 0
            for b in waiting:
                yield with_columns(b, [("likely", pa.float64(), pa.array(found[at : at + b.num_rows]))], ("codes",))
                at += b.num_rows
            waiting.clear()

        for batch in chunks(batches, "codes"):
            waiting.append(batch)
            size += pa.compute.sum(pa.compute.binary_length(batch.column(batch.schema.get_field_index("codes")))).as_py() // 2
            if size >= HELD:
                yield from out()
                size = 0
        if waiting:
            yield from out()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "codes")
    return rest.mapInArrow(run, f"{schema}, likely double")


def scores(texts: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row per row that was coded.

    base_score is the text's log10 probability by add-one unigrams, score that by the
    model. A null or empty text has one token, its end; texts of any length are scored
    whole. Equal texts have equal scores but for rounding; extra columns of the documents
    don't take part, so none can clash.
    """
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times", "r.other").join(counts, "word")
    logs = F.col("times") * F.log10(F.col("n") + 1)
    # the net gives its own words a probability; within the classes of other words counts do
    rare = rare.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(logs).alias("more_sum"), F.sum(F.when(F.col("other"), logs)).alias("other_sum"))
    whole = likely(texts.drop("rare", "h", "learn"), model.net).join(rare, "row", "left")
    more = F.coalesce("more_sum", F.lit(0.0))
    base = F.col("known_sum") + more - F.col("n_tokens") * math.log10(model.tokens + model.distinct + 1)
    return whole.select(
        doc_id, "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("likely") + F.col("part_sum") + F.coalesce("other_sum", F.lit(0.0))).alias("score"),
    )


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """scores() of other documents than those that train() has coded."""
    return scores(coded(docs, model, doc_id, text), model, counts, doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts, texts = train(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return scores(texts, model, counts).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_score": query}
