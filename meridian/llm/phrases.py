"""Phrase collocations of two and three words by level-wise candidates and double-array tries.

A word of a language is known by a 64-bit hash (checked to be free of collisions on the
table's own words; else another seed is taken). Passes over the texts:

1. words are counted by language;
2. pairs of frequent words are counted by a key of 48 bits, which can only count too many;
3. triples whose both pairs passed are counted likewise;
4. places of phrases that passed are dealt to parts by a hash of the phrase, equal ones of a
   task's text as one with its count: every phrase that is frequent is among them, as its
   parts are frequent too. A part's task builds tries of its phrases, TRIE at most in each. In
   numpy all places take their states from level to level at once; accepting states are
   counted by bincount.

The number of passes doesn't grow with the table. The counts of the last pass are exact and are
those that scores rest on. What is broadcast is a bitmap of at most MOST_BITS; what a task holds
is a window of text and these, or a part's phrases (of PART_TOKENS words of text) and one trie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .common import chunks, hot_values, small_batches, spread_join, table

#: candidates of a trie
TRIE = 1 << 19
#: bits of a bitmap: so many a value, a power of two between these; and of the part that a task puts together
BITS_EACH, FEWEST_BITS, MOST_BITS, PART = 32, 1 << 16, 1 << 29, 1 << 20
#: bytes of text whose words are hashed at once
WINDOW = 1 << 20
#: hashes that a task holds before it counts them; words of text whose phrases one task counts
HELD, PART_TOKENS = 1 << 20, 1 << 22
#: a word's number in a trie goes over two levels of so many bits
DIGIT = 11
SEEDS = 8
#: bits that a key is shifted by for its second place in a bitmap
SECOND = 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WORD, _SPACE, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return _mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


@dataclass
class Words:
    """Words of a window of text in order: the first ``new`` are the last of the window before.

    ``breaks``: nothing links a word to the one before. docs, starts and ends (of the bytes)
    are of the others.
    """

    hashes: np.ndarray
    breaks: np.ndarray
    new: int
    docs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Hasher:
    """Hashes of all words of texts: prefix sums of byte values times powers, without a Python object a word."""

    def __init__(self, seed: int) -> None:
        codes = np.arange(256, dtype=np.uint64)
        self.seed, self.values = seed, _mix(codes * np.uint64(_BASE) + np.uint64(seed + 1))
        self.values[65:91] = self.values[97:123]
        factor = (0x5851F42D4C957F2D + 2 * seed) | 1
        self.powers, self.inverse = (self._powers(x) for x in (factor, pow(factor, -1, 1 << 64)))
        self.block = np.uint64(pow(factor, WINDOW, 1 << 64))

    @staticmethod
    def _powers(x: int) -> np.ndarray:
        out = np.full(WINDOW, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _long(self, word: np.ndarray) -> np.ndarray:
        """The hash of one word of any length, block by block."""
        total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        for at in range(0, len(word), WINDOW):
            part = word[at : at + WINDOW]
            total += (self.values[part] * self.powers[: len(part)]).sum(dtype=np.uint64) * factor
            factor = factor * self.block
        return total

    def windows(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> Iterator[Words]:
        """Words of texts that lie one after the other in data; langs: a hash for each text."""
        last_hashes, last_breaks, pending, lo = np.zeros(0, np.uint64), np.zeros(0, bool), True, 0
        while lo < len(data):
            hi = min(len(data), lo + WINDOW)
            kinds = _CLASS[data[lo:hi]]
            first = np.zeros(hi - lo, bool)
            inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)]
            first[inside - lo] = True
            if hi < len(data) and hi not in offsets[np.searchsorted(offsets, hi) : np.searchsorted(offsets, hi) + 1]:
                # whole words only
                stops = np.flatnonzero((kinds != _WORD) | first)
                if len(stops) and (stops[-1] > 0 or kinds[0] != _WORD):
                    keep = int(stops[-1]) + (kinds[stops[-1]] != _WORD)
                    hi, kinds, first = lo + keep, kinds[:keep], first[:keep]
                else:
                    hi = self._end_of_word(data, offsets, hi)
            if hi - lo > WINDOW:  # one word
                starts, ends, hashes = np.array([lo]), np.array([hi]), self._long(data[lo:hi])
                cuts = np.array([lo]) if first[0] else np.zeros(0, np.int64)
            else:
                is_word = kinds == _WORD
                before = np.append(False, is_word[:-1])
                starts = np.flatnonzero(is_word & (~before | first))
                ends = np.flatnonzero(is_word & np.append(~is_word[1:] | first[1:], True)) + 1
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data[lo:hi]] * self.powers[: hi - lo], dtype=np.uint64)])
                hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
                cuts = np.flatnonzero((kinds == _BREAK) | first) + lo
                starts, ends = starts + lo, ends + lo
            docs = np.searchsorted(offsets, starts, side="right") - 1
            hashes = _mix(_mix(hashes ^ ((ends - starts).astype(np.uint64) * np.uint64(_BASE))) ^ langs[docs])
            hashes[hashes == 0] = 1
            seen = np.searchsorted(cuts, starts, side="right")
            if len(starts):
                breaks = np.append(seen[0] > 0 or pending, seen[1:] != seen[:-1])
                pending = len(cuts) > seen[-1]
                hashes, breaks = np.append(last_hashes, hashes), np.append(last_breaks, breaks)
                yield Words(hashes, breaks, len(last_hashes), docs, starts, ends)
                last_hashes, last_breaks = hashes[-2:], breaks[-2:]
            else:
                pending |= len(cuts) > 0
            lo = hi

    @staticmethod
    def _end_of_word(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
        text_end = int(offsets[np.searchsorted(offsets, at, side="right")])
        while at < text_end:
            stops = np.flatnonzero(_CLASS[data[at : min(text_end, at + WINDOW)]] != _WORD)
            if len(stops):
                return at + int(stops[0])
            at = min(text_end, at + WINDOW)
        return text_end

    def batch(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], Words]]:
        """(bytes, languages of the texts, words) of the windows of a batch (lang, text) without nulls."""
        names = batch.column(0).to_pylist()
        known = {name: xxhash.xxh64_intdigest(name, self.seed) for name in set(names)}
        column = batch.column(1).cast(pa.string())
        _, ends, held = column.buffers()
        offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = (np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        langs = np.array([known[name] for name in names], np.uint64)
        for words in self.windows(data, offsets - offsets[0], langs):
            yield data, names, words


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _links(words: Words) -> np.ndarray:
    """Places (from the second) of words that follow the one before."""
    return ~words.breaks[1:]


def _pairs(words: Words) -> np.ndarray:
    return then(words.hashes[:-1], words.hashes[1:])


def _key(hashes: np.ndarray) -> np.ndarray:
    """The 48 bits of a hash by which phrases are counted before they are known."""
    return hashes >> np.uint64(16)


def _low(bits: int) -> np.ndarray:
    return np.uint64((1 << (48 - bits)) - 1)


def _part_bits(tokens: int) -> int:
    return max(8, (max(1, tokens) // PART_TOKENS).bit_length())


def often(texts: DataFrame, seed: int, tokens: int, fewest: int, each: Callable[[Words], np.ndarray]) -> DataFrame:
    """(h): the keys of the hashes that ``each`` finds in windows, of those found ``fewest`` times at least.

    Tasks count and pack what they found by the first bits of the key (the part); a part's
    counts, of PART_TOKENS words of text on average, are summed by one task.
    """
    bits = _part_bits(tokens)

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        part = (keys >> np.uint64(48 - bits)).astype(np.int32)
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        low = (keys & _low(bits)).view(np.uint8).reshape(-1, 8)[:, :5]
        stop = np.append(start[1:], len(keys))
        n = np.minimum(n, 255).astype(np.uint8) if fewest <= 255 else n.astype(np.uint32)
        rows = zip(start.tolist(), stop.tolist(), strict=True)
        blobs = [(low[i:j].tobytes(), n[i:j].tobytes()) for i, j in rows]
        return pa.RecordBatch.from_arrays([pa.array(part[start]), *(pa.array([b[k] for b in blobs], pa.binary()) for k in (0, 1))], names=["part", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(seed), [], 0
        for batch in chunks(batches):
            for _, _, words in hasher.batch(batch):
                held.append(_key(each(words)))
                size += len(held[-1])
                if size >= HELD:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def merged(rows: pa.Table) -> pa.Table:
        width = 1 if fewest <= 255 else 4
        low = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint8).reshape(-1, 5)
        n = np.frombuffer(b"".join(rows.column("n").to_pylist()), np.uint8 if width == 1 else np.uint32)
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, :5] = low
        keys = keys.view(np.uint64).ravel()
        by = np.argsort(keys)
        keys = keys[by]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keep = keys[start][np.add.reduceat(n[by], start, dtype=np.int64) >= fewest]
        return pa.table({"h": _signed(keep + (np.uint64(rows.column("part")[0].as_py()) << np.uint64(48 - bits)))})

    return texts.mapInArrow(run, "part int, keys binary, n binary").groupBy("part").applyInArrow(merged, "h long")


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, f): occurrences of each word of each language, with the word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for batch in chunks(batches, most=1 << 22):
            found = [(names, data, w) for data, names, w in hasher.batch(batch)]
            if not found:
                continue
            names, data, _ = found[0]
            values, at, n = np.unique(np.concatenate([w.hashes[w.new :] for _, _, w in found]), return_index=True, return_counts=True)
            starts, ends, docs = (np.concatenate([getattr(w, c) for _, _, w in found])[at].tolist() for c in ("starts", "ends", "docs"))
            whole = data.tobytes().translate(_LOWER)
            said = [whole[i:j].decode() for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([_signed(values), pa.array([names[i] for i in docs], pa.string()), pa.array(said, pa.string()), pa.array(n)], names=["h", "lang", "word", "n"])

    return texts.mapInArrow(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("f"))


def bitmap(values: DataFrame) -> np.ndarray:
    """A bitmap of the keys ``h``, two bits for each, put together in parts of PART bits by tasks; at most MOST_BITS.

    With BITS_EACH bits a key, one key in 256 passes that isn't among them; never one too few.
    """
    count = values.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * count - 1).bit_length()))
    both = F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftrightunsigned("h", SECOND), F.lit(bits)))
    slots = values.select(F.explode(both).alias("slot")).distinct()
    parts = slots.select(F.floor(F.col("slot") / PART).cast("int").alias("part"), (F.col("slot") % PART).cast("int").alias("at"))

    def put(rows: pa.Table) -> pa.Table:
        mark = np.zeros(PART, bool)
        mark[rows.column("at").to_numpy()] = True
        return pa.table({"part": rows.column("part").slice(0, 1), "bits": pa.array([np.packbits(mark, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(max(bits, PART) // 8, np.uint8)
    for r in parts.groupBy("part").applyInArrow(put, "part int, bits binary").collect():
        out[r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.bits, np.uint8)
    return out[: bits // 8]


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes' keys have both their bits."""
    mask, keys = np.uint64(8 * len(bits) - 1), _key(hashes)

    def bit(slot: np.ndarray) -> np.ndarray:
        return ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    found = bit(keys & mask)
    found[found] = bit((keys[found] >> np.uint64(SECOND)) & mask)
    return found


def frequent_pairs(texts: DataFrame, seed: int, tokens: int, fewest: int, frequent: np.ndarray) -> DataFrame:
    """(h): keys of pairs of marked words; no pair that occurs ``fewest`` times is missing."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def each(words: Words) -> np.ndarray:
        known = marked(shared.value, words.hashes)
        ends = _links(words) & known[1:] & known[:-1]
        ends[: max(words.new - 1, 0)] = False
        return _pairs(words)[ends]

    return often(texts, seed, tokens, fewest, each)


def frequent_triples(texts: DataFrame, seed: int, tokens: int, fewest: int, pairs: np.ndarray) -> DataFrame:
    """(h): keys of triples whose both pairs are marked, likewise."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)
    return often(texts, seed, tokens, fewest, lambda words: _marked_triples(words, shared.value)[2])


def _marked_triples(words: Words, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which words but the first end a marked pair, places where a triple of marked pairs begins, the triples' hashes)."""
    found = _pairs(words)
    good = _links(words)
    good[good] = marked(pairs, found[good])
    begins = np.flatnonzero(good[1:] & good[:-1])
    begins = begins[begins + 2 >= words.new]
    return good, begins, then(found[begins], words.hashes[begins + 2])


def _once(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of (3, n) put together by a hash of theirs, equal ones as one; n summed.

    (Columns that share a hash may be left as several.)
    """
    if not rows.shape[1]:
        return rows, n
    by = np.argsort(then(then(rows[0], rows[1]), rows[2]))
    rows = rows[:, by]
    start = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0)))
    return rows[:, start], np.add.reduceat(n[by], start, dtype=np.uint32)


def _places(texts: DataFrame, seed: int, tokens: int, pairs: np.ndarray, triples: np.ndarray) -> DataFrame:
    """(part, phrases, n): the marked pairs (h3 is 0) and triples that tasks have seen, once each
    with their places' number, packed by a hash's first bits (the part)."""
    context, bits = texts.sparkSession.sparkContext, _part_bits(tokens)
    shared = context.broadcast(pairs), context.broadcast(triples)

    def packed(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (then(then(rows[0], rows[1]), rows[2]) >> np.uint64(64 - bits)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        part, rows, n = part[by], rows[:, by], n[by]
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        spans = list(zip(start.tolist(), np.append(start[1:], len(part)).tolist(), strict=True))
        blobs = [[c[..., i:j].tobytes() for i, j in spans] for c in (rows, n)]
        return pa.RecordBatch.from_arrays([pa.array(part[start]), *(pa.array(b, pa.binary()) for b in blobs)], names=["part", "phrases", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros((3, 0), np.uint64), np.zeros(0, np.uint32)
        hasher, known, held, size = Hasher(seed), nothing, [], 0

        def together() -> tuple[np.ndarray, np.ndarray]:
            found = np.concatenate(held, axis=1) if held else nothing[0]
            return _once(np.concatenate([known[0], found], axis=1), np.append(known[1], np.ones(found.shape[1], np.uint32)))

        for batch in chunks(batches):
            for _, _, words in hasher.batch(batch):
                good, begins, hashes = _marked_triples(words, shared[0].value)
                good[: max(words.new - 1, 0)] = False
                at, h = np.flatnonzero(good), words.hashes
                begins = begins[marked(shared[1].value, hashes)]
                held.append(np.stack([h[at], h[at + 1], np.zeros(len(at), np.uint64)]))
                held.append(np.stack([h[begins + k] for k in range(3)]))
                size += len(at) + len(begins)
                if size >= HELD:
                    known, held, size = together(), [], 0
                    # so that no count passes 32 bits, too
                    if len(known[1]) >= 2 * HELD or int(known[1].max(initial=0)) >= 1 << 31:
                        yield packed(*known)
                        known = nothing
        known = together()
        if len(known[1]):
            yield packed(*known)

    return texts.mapInArrow(run, "part int, phrases binary, n binary")


def count_candidates(texts: DataFrame, seed: int, tokens: int, pairs: np.ndarray, triples: np.ndarray) -> DataFrame:
    """(h1, h2, h3, a): exact occurrences of the marked pairs (h3 is 0) and triples, in one pass over the texts.

    A part's places, and no others, are taken through tries of the part's phrases by one task.
    """

    def counted(rows: pa.Table) -> pa.Table:
        places = np.concatenate([np.frombuffer(x, np.uint64).reshape(3, -1) for x in rows.column("phrases").to_pylist()], axis=1)
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("n").to_pylist()])
        found = []
        phrases = _different(places)
        for at in range(0, phrases.shape[1], TRIE):
            trie = Trie(phrases[:, at : at + TRIE])
            found.append(trie.count_places(places, n))
        return pa.table([*[_signed(r) for r in phrases], pa.array(np.concatenate(found))], names=["h1", "h2", "h3", "a"])

    return _places(texts, seed, tokens, pairs, triples).groupBy("part").applyInArrow(counted, "h1 long, h2 long, h3 long, a long")


def _different(rows: np.ndarray) -> np.ndarray:
    """The different columns of (3, n), sorted."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))]


class Trie:
    """A double array over phrases of word hashes.

    A word is its number among the phrases' words, taken as two digits. From state s digit
    d leads to base[s] + d if check of that is s. accept gives a phrase's place, or -1.
    """

    def __init__(self, phrases: np.ndarray) -> None:
        """phrases: (3, n) hashes, the third 0 for a pair."""
        self.phrases = phrases
        self.words = np.unique(phrases[phrases != 0])
        width = 1 << DIGIT
        numbers = np.searchsorted(self.words, phrases)
        parent, rows = np.zeros(phrases.shape[1], np.int64), np.arange(phrases.shape[1])
        nodes, ups, digits = 1, [], []
        terminal = np.zeros(phrases.shape[1], np.int64)
        for word in range(3):
            if word == 2:
                rows = rows[phrases[2, rows] != 0]
            for shift in (DIGIT, 0):
                digit = (numbers[word, rows] >> shift) & (width - 1)
                keys, place = np.unique(parent[rows] * width + digit, return_inverse=True)
                ups.append(keys // width)
                digits.append(keys % width)
                parent[rows] = nodes + place
                nodes += len(keys)
            terminal[rows] = parent[rows]
        self._place(nodes, np.concatenate(ups), np.concatenate(digits), terminal)

    def _place(self, nodes: int, ups: np.ndarray, digits: np.ndarray, terminal: np.ndarray) -> None:
        """Give every node a base at which its children's slots are free, those with most children first."""
        width, draw = 1 << DIGIT, np.random.default_rng(1)
        # nodes were numbered so that children of one node lie together
        inner, begin, degree = np.unique(ups, return_index=True, return_counts=True)
        used = np.zeros(2 * nodes + 2 * width, bool)
        used[0] = True
        base = np.zeros(nodes, np.int64)
        for k in np.unique(degree)[::-1]:
            left = np.flatnonzero(degree == k)
            lowest, tries = 0, 0
            while len(left):
                if tries == 24:  # too full: go on in new space
                    lowest, tries = len(used) - width, 0
                    used = np.append(used, np.zeros(max(len(used) // 2, width * min(len(left), 64)), bool))
                tried = draw.integers(lowest, len(used) - width, len(left))
                slots = tried[:, None] + digits[begin[left][:, None] + np.arange(k)]
                free = np.flatnonzero(~used[slots].any(1))
                owner = np.full(len(used), -1, np.int32) if len(free) > 64 else None
                if owner is not None:
                    owner[slots[free]] = free[:, None]
                    won = free[(owner[slots[free]] == free[:, None]).all(1)]
                else:
                    won = free[:1]
                used[slots[won]] = True
                base[inner[left[won]]] = tried[won]
                left = np.delete(left, won)
                tries = 0 if len(won) else tries + 1
        slot = np.zeros(nodes, np.int64)
        slot[1:] = base[ups] + digits
        size = len(used)
        self.base, self.check, self.accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[ups]
        self.accept[slot[terminal]] = np.arange(len(terminal))

    def _step(self, states: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """States after one more word; -1 where there is none."""
        for digit in (numbers >> DIGIT, numbers & ((1 << DIGIT) - 1)):
            to = self.base[states] + digit
            states = np.where((states >= 0) & (self.check[to] == states), to, -1)
        return states

    def count(self, words: Words, counts: np.ndarray) -> None:
        """Add the phrases of a window, that end in its new words, to counts."""
        numbers = np.searchsorted(self.words, words.hashes)
        known = self.words[np.minimum(numbers, len(self.words) - 1)] == words.hashes
        at = np.flatnonzero(known[:-1] & known[1:] & ~words.breaks[1:])
        states = self._step(np.zeros(len(at), np.int64), numbers[at])
        for level in (1, 2):
            live = states >= 0
            at, states = at[live], states[live]
            if level == 2:
                on = at + 2 < len(numbers)
                at, states = at[on], states[on]
                on = known[at + 2] & ~words.breaks[at + 2]
                at, states = at[on], states[on]
            states = self._step(states, numbers[at + level])
            done = self.accept[states[(states >= 0) & (at + level >= words.new)]]
            counts += np.bincount(done[done >= 0], minlength=len(counts))


    def count_places(self, places: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often each phrase occurs, from places (3, n) of phrases, known here or not, and how often each was seen."""
        counts = np.zeros(self.phrases.shape[1], np.int64)
        for begin in range(0, len(n), HELD):
            part, times = places[:, begin : begin + HELD], n[begin : begin + HELD]
            numbers = np.minimum(np.searchsorted(self.words, part), len(self.words) - 1)
            known, single = self.words[numbers] == part, part[2] == 0
            at = np.flatnonzero(known[0] & known[1] & (single | known[2]))
            states = np.zeros(len(at), np.int64)
            for level in (0, 1, 2):
                on = (level < 2) | ~single[at]
                states[on] = self._step(states[on], numbers[level, at[on]])
            at, done = at[states >= 0], self.accept[states[states >= 0]]
            at, done = at[done >= 0], done[done >= 0]
            # halves, as bincount adds doubles
            for shift in (0, 16):
                counts += np.bincount(done, (times[at] >> shift) & 0xFFFF, len(counts)).astype(np.int64) << shift
        return counts


def _looked_up(rows: DataFrame, words: DataFrame, key: str, **columns: str) -> DataFrame:
    """rows joined with columns of words (h) on rows' key; frequent keys are spread."""
    hot = hot_values(rows.groupBy(key).agg(F.count("*").alias("n")), key, "n")
    return spread_join(rows, words.select(F.col("h").alias(key), *[F.col(c).alias(name) for name, c in columns.items()]), key, hot)


def _pair_key(a: str, b: str) -> Column:
    return F.concat_ws(":", a, b)


def _score(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of up to 38 digits."""
    a, b, c = (f"cast({x} as decimal(15,0))" for x in ("a", left, right))
    return F.expr(f"cast(cast(1000000 as decimal(7,0)) * ({a} * {a}) div ({b} * {c}) as long)")


RESULT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
#: places that a language's phrases are ranked in first
SHARDS = 16


def _words(texts: DataFrame) -> tuple[int, DataFrame]:
    """(seed, words): the words' counts, under a seed by which no two of them share a hash."""
    for seed in range(SEEDS):
        words = stored(count_words(texts, seed), "words")
        if words.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return seed, words
    raise RuntimeError(f"words share hashes under each of {SEEDS} seeds")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", fewest: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two and three words.

    Letters A-Z count as lower case; words are what spaces and tabs part inside pieces, which
    full stops, commas and the like and line breaks end. a, l and r are the occurrences of the
    phrase and of its two parts, n those of all words of the language; of a triple's two cuts
    the one of lower score counts. A pair inside a triple that occurs at least ``fewest``
    times and in at least ``cover`` hundredths of the pair's occurrences is left out.

    A null text has no words, a null language is ``und``; repeated rows count each time; texts
    of any length are read whole. An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    seed, words = _words(texts)
    frequent = stored(words.filter(F.col("f") >= fewest), "frequent-words")
    tokens = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    known = bitmap(frequent.select(F.shiftrightunsigned("h", 16).alias("h")))
    pairs = stored(frequent_pairs(texts, seed, tokens, fewest, known), "pair-keys")
    if pairs.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    pair_bits = bitmap(pairs)
    triples = stored(frequent_triples(texts, seed, tokens, fewest, pair_bits), "triple-keys")
    counted = stored(count_candidates(texts, seed, tokens, pair_bits, bitmap(triples)).filter(F.col("a") >= fewest), "counts")
    return ranked(counted, frequent, words.groupBy("lang").agg(F.sum("f").alias("n")), cover, top)


def ranked(counted: DataFrame, words: DataFrame, sizes: DataFrame, cover: int, top: int) -> DataFrame:
    """collocations() from counts (h1, h2, h3, a), words (h, lang, word, f) and the languages' sizes (lang, n)."""
    two = counted.filter("h3 = 0").select("h1", "h2", "a")
    two = _looked_up(two, words, "h1", lang="lang", w1="word", f1="f")
    two = stored(_looked_up(two, words, "h2", w2="word", f2="f").withColumn("key", _pair_key("h1", "h2")), "pairs")
    three = counted.filter("h3 <> 0").withColumns({"first": _pair_key("h1", "h2"), "rest": _pair_key("h2", "h3")})
    within = three.select(F.explode(F.array("first", "rest")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    pairs = two.join(within, "key", "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * cover, F.lit(True)))
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"))

    known = two.withColumnRenamed("key", "h")
    three = _looked_up(three, known.select("h", F.col("a").alias("f")), "first", a12="f")
    three = _looked_up(three, known.select("h", F.col("a").alias("f")), "rest", a23="f")
    three = _looked_up(three, words, "h1", lang="lang", w1="word", f1="f")
    three = _looked_up(_looked_up(three, words, "h2", w2="word"), words, "h3", w3="word", f3="f")
    cuts = [F.struct(_score(x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("f1", "a23"), ("a12", "f3")))]
    triples = three.withColumn("cut", F.least(*cuts)).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), "phrase"]
    scored = pairs.union(triples).withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)))
    for place in (["lang", "shard"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return scored.join(sizes, "lang").select(*RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with texts as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, doc, unnest(pieces) as piece, generate_subscripts(pieces, 1) as p from (select lang, doc, regexp_split_to_array(text, '[.,;:!?
-
]') as pieces from texts)
), words as (
  select lang, doc, p, unnest(ws) as word, generate_subscripts(ws, 1) as i from (select lang, doc, p, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as ws from pieces)
), grams as (
  select lang, word as w1, lead(word) over x as w2, lead(word, 2) over x as w3 from words window x as (partition by doc, p order by i)
), one as materialized (select lang, w1, count(*) as f from grams group by all),
two as materialized (select lang, w1, w2, count(*) as a from grams where w2 is not null group by all having count(*) >= 10),
three as materialized (select lang, w1, w2, w3, count(*) as a from grams where w3 is not null group by all having count(*) >= 10),
inside as (
  select lang, w1, w2, max(a) as longer from (select lang, w1, w2, a from three union all select lang, w2, w3, a from three) group by all
), cuts as (
  select t.lang, t.w1 || ' ' || t.w2 as phrase, t.a, x.f as l, y.f as r, 1 as k
  from two t join one x on x.lang = t.lang and x.w1 = t.w1 join one y on y.lang = t.lang and y.w1 = t.w2
  left join inside i on i.lang = t.lang and i.w1 = t.w1 and i.w2 = t.w2 where i.longer is null or 100 * i.longer < 50 * t.a
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.f, y.a, 1
  from three t join one x on x.lang = t.lang and x.w1 = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.a, y.f, 2
  from three t join two x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join one y on y.lang = t.lang and y.w1 = t.w3
), scored as (
  select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best join (select lang, sum(f)::bigint as n from one group by lang) using (lang) qualify rank <= 2000
"""

QUERIES = {"op13_phrases": query}
ORACLES = {"op13_phrases": SQL}
