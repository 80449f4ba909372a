"""Byte-level BPE encoding and decoding over whole texts.

Pre-tokens are found without a regular expression: every code point gets a symbol (its
class, with a look at the two after it), every symbol is a function from scanner states to
scanner states, and an associative scan composes those functions. The few functions that
can arise are numbered, so composing is one look-up in a table. A code point begins a
pre-token where its symbol says so in the state before it. Each distinct pre-token is
merged once per worker and kept in a cache of bounded size.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh, table, text_bytes, with_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: pre-tokens that a worker keeps, in two generations
CACHE = 300_000
#: bytes of text that are encoded at once
ENCODED = 1 << 20
#: code points scanned at once
SCAN = 1 << 19

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, RESET = range(7)
# Symbols: the first four are classes as they are; a quote may begin a contraction of one or
# two letters, a white space may be the last before something else.
L, N, O, Q1, Q2, TAIL_SPACE, TAIL_BLANK, INNER, END = range(9)
# Scanner states.
START, IN_L, IN_N, IN_O, GLUED, IN_BLANK, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol and whether a pre-token begins at it."""
    if symbol == END:
        return START, True
    if state in (ONE_LEFT, TWO_LEFT):  # inside a contraction, which only letters follow
        return (START if state == ONE_LEFT else ONE_LEFT), False
    if symbol == INNER:
        return IN_BLANK, state != IN_BLANK
    if symbol == TAIL_BLANK:
        return START, True
    if symbol == TAIL_SPACE:
        return GLUED, True
    if symbol in (Q1, Q2):
        if state in (GLUED, IN_O):
            return IN_O, False
        return (ONE_LEFT if symbol == Q1 else TWO_LEFT), True
    own = {L: IN_L, N: IN_N, O: IN_O}[symbol]
    return own, state not in (own, GLUED)


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each symbol; composition; value at START; where pre-tokens begin."""
    states, symbols = range(8), range(9)
    first = [tuple(_step(s, x)[0] for s in states) for x in symbols]
    known = {tuple(states): 0}
    for f in first:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in first:
            new = tuple(g[s] for s in f)
            if new not in known:
                known[new] = len(known)
                todo.append(new)
    functions = np.array(list(known), np.uint8)
    number = {tuple(f): i for i, f in enumerate(functions.tolist())}
    composed = np.array([[number[tuple(functions[g][f])] for g in range(len(functions))] for f in functions], np.uint16)
    begins = np.array([[_step(s, x)[1] for x in symbols] for s in states])
    return np.array([number[f] for f in first], np.uint16), composed, functions[:, START], begins


# Letters and numbers that Unicode 16 added (the library's tables have them,
# unicodedata's may not).
ADDED = [
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER),
    (0x10D40, 0x10D49, NUMBER), (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER),
    (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER), (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER),
    (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER), (0x116D0, 0x116E3, NUMBER),
    (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER),
    (0x1CCF0, 0x1CCF9, NUMBER), (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
]
# The code points with the White_Space property.
BLANKS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    known = {"L": LETTER, "N": NUMBER}
    out = np.array([known.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for low, high, kind in ADDED:
        out[low : high + 1] = kind
    out[BLANKS] = BLANK
    out[0x20] = SPACE
    out[0x27] = QUOTE
    return out


def _symbols(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Symbol of each code point of texts that a RESET ends each."""
    n = len(points)
    out = np.array([L, N, O, INNER, INNER, O, END], np.uint8)[kinds]
    blank = (kinds == SPACE) | (kinds == BLANK)
    tail = blank.copy()
    tail[:-1] &= ~blank[1:] & (kinds[1:] != RESET)
    out[tail & (kinds == SPACE)] = TAIL_SPACE
    out[tail & (kinds == BLANK)] = TAIL_BLANK
    at = np.flatnonzero(kinds == QUOTE)
    if len(at):
        a, b = points[np.minimum(at + 1, n - 1)], points[np.minimum(at + 2, n - 1)]
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = Q1
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[at[two]] = Q2
    return out


def _scan(functions: np.ndarray, composed: np.ndarray) -> np.ndarray:
    """Exclusive scan: the composition of all functions before each position."""
    n = len(functions)
    width = max(1, int(n**0.5) // 2)
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = composed.ravel(), np.uint32(len(composed))
    inside = np.empty_like(grid)
    now = np.zeros(rows, np.uint16)
    for j in range(width):
        inside[j] = now
        now = flat[now * size + grid[j]]
    # the blocks' totals, by doubling
    step, totals = 1, now
    while step < rows:
        totals = np.concatenate([totals[:step], flat[totals[:-step] * size + totals[step:]]])
        step *= 2
    before = np.concatenate([np.zeros(1, np.uint16), totals[:-1]])
    return np.ascontiguousarray(flat[before[None, :] * size + inside].T).ravel()[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; a text ends in code point 0x110000 (it counts as a beginning)."""
    kinds = np.full(len(points), RESET, np.uint8)
    real = points < 0x110000
    kinds[real] = _classes()[points[real]]
    symbols = _symbols(points, kinds)
    number, composed, at_start, begins = _machine()
    before = at_start[_scan(number[symbols], composed)]
    return np.flatnonzero(begins.ravel()[before.astype(np.intp) * 9 + symbols])


@functools.cache
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


#: pre-tokens of up to so many bytes are merged many at a time
TOGETHER = 40
NONE = 1 << 30


class Encoder(dict):
    """Token ids (little-endian uint32) of a pre-token; merges what it hasn't seen and keeps it."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.ranks = vocabulary(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint32)
        pairs, made = array("I"), array("i")
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    pairs.append(a << 16 | b)
                    made.append(rank)
        order = np.argsort(np.frombuffer(pairs, np.uint32))
        self.pairs = np.frombuffer(pairs, np.uint32)[order]
        self.pair_rank = np.frombuffer(made, np.int32)[order]

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            found = np.array((whole,) if whole is not None else merged(data, self.ranks), "<u4").tobytes()
            if len(data) > 256:
                return found
        self[piece] = found
        return found

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the tokens that adjacent tokens would merge to (NONE: they don't)."""
        key = a << np.uint32(16) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)

    def learn(self, pieces: set[str]) -> None:
        """Merge the pre-tokens not seen before, all that have equally many tokens left at a time."""
        if len(self) >= CACHE // 2:
            self.old = dict(self)
            self.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in [p for p in pieces if p not in self and p not in self.old]:
            data = piece.encode()
            if data in self.ranks:
                self[piece] = self.ranks[data].to_bytes(4, "little")
            elif len(data) <= TOGETHER:
                by_size.setdefault(len(data), []).append((piece, data))
        names: list[str] = []
        ids, ranks = np.zeros((0, 0), np.uint32), np.zeros((0, 0), np.int32)
        for size in range(max(by_size, default=0), 1, -1):
            if new := by_size.get(size):
                fresh_ids = self.byte[np.frombuffer(b"".join(d for _, d in new), np.uint8).reshape(-1, size)]
                fresh_ranks = self.rank_of(fresh_ids[:, :-1], fresh_ids[:, 1:])
                if names:
                    fresh_ids, fresh_ranks = np.concatenate([ids, fresh_ids]), np.concatenate([ranks, fresh_ranks])
                ids, ranks, names = fresh_ids, fresh_ranks, names + [p for p, _ in new]
            if not names:
                continue
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(at)), at]
            done = low == NONE
            self._keep([names[i] for i in np.flatnonzero(done).tolist()], ids[done])
            go = np.flatnonzero(~done)
            names = [names[i] for i in go.tolist()]
            if not names:
                ids, ranks = np.zeros((0, size - 1), np.uint32), np.zeros((0, size - 2), np.int32)
                continue
            ids, ranks, at, n = ids[go], ranks[go], at[go], np.arange(len(go))
            ids[n, at] = low[go]
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            ids = ids[keep].reshape(len(n), size - 1)
            keep = np.ones(ranks.shape, bool)
            keep[n, at] = False
            ranks = ranks[keep].reshape(len(n), size - 2)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank_of(ids[some, at[some] - 1], ids[some, at[some]])
            some = np.flatnonzero(at < size - 2)
            ranks[some, at[some]] = self.rank_of(ids[some, at[some]], ids[some, at[some] + 1])
        self._keep(names, ids)

    def _keep(self, names: list[str], ids: np.ndarray) -> None:
        data, size = ids.astype("<u4", copy=False).tobytes(), 4 * ids.shape[1]
        for i, name in enumerate(names):
            self[name] = data[i * size : (i + 1) * size]


def merged(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids after merging, again and again, the adjacent pair of lowest rank (leftmost first)."""
    if len(data) > 200:
        return _merged_long(data, ranks)
    get, none = ranks.get, 1 << 60
    cuts = list(range(len(data) + 1))
    score = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
    while score:
        low = min(score)
        if low == none:
            break
        i = score.index(low)
        del cuts[i + 1], score[i]
        if i < len(score):
            score[i] = get(data[cuts[i] : cuts[i + 2]], none)
        if i:
            score[i - 1] = get(data[cuts[i - 1] : cuts[i + 1]], none)
    return tuple(ranks[data[a:b]] for a, b in zip(cuts, cuts[1:], strict=False))


def _merged_long(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap, for long pre-tokens."""
    from heapq import heapify, heappop, heappush

    n = len(data)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapify(heap)
    alive = [True] * (n + 1)
    while heap:
        _, i, middle, end = heappop(heap)
        if not (alive[i] and after[i] == middle and middle < n and alive[middle] and after[middle] == end):
            continue
        alive[middle] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(data[i : after[end]])) is not None:
                heappush(heap, (r, i, end, after[end]))
        if i and (r := ranks.get(data[before[i] : end])) is not None:
            heappush(heap, (r, before[i], i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : after[i]]])
        i = after[i]
    return tuple(out)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(texts: list[str], ids_of: Encoder) -> Iterator[bytes]:
    """Ids (little-endian uint32) of each text."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < SCAN):
            size += len(texts[end]) + 1
            end += 1
        some = texts[begin:end]
        points = np.full(size, 0x110000, np.uint32)
        at = 0
        for t in some:
            points[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            at += len(t) + 1
        cuts = boundaries(points)
        ends = np.flatnonzero(points == 0x110000)
        # a text's own cuts, from its first code point
        last = np.searchsorted(cuts, ends, side="right")
        start, first, pieces = 0, 0, []
        for t, stop, to in zip(some, ends.tolist(), last.tolist(), strict=True):
            own = (cuts[first:to] - start).tolist()
            pieces.append([t[a:b] for a, b in zip(own, own[1:], strict=False)])
            start, first = stop + 1, to
        ids_of.learn(set().union(*pieces))
        for own in pieces:
            yield b"".join([ids_of[p] for p in own])
        begin = end


@functools.cache
def decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, where each begins there, and its size."""
    ranks = vocabulary(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    by_rank = [b""] * len(sizes)
    for piece, rank in ranks.items():
        sizes[rank], by_rank[rank] = len(piece), piece
    return np.frombuffer(b"".join(by_rank), np.uint8), np.cumsum(sizes) - sizes, sizes


def placed(pieces: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The text whose token i is ids[i] and ends at byte ends[i]."""
    own = sizes[ids]
    begins = np.r_[0, ends[:-1]].astype(np.int64)[: len(ends)]
    if len(ends) != len(ids) or not np.array_equal(ends - begins, own):
        raise ValueError("offsets don't fit the token ids")
    # byte by byte: where its token begins in the text, and where in the vocabulary
    return pieces[np.arange(int(own.sum())) + np.repeat(starts[ids] - begins, own)].tobytes()


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """docs with ``token_ids`` binary (little-endian uint32 each) and, if asked for,
    ``token_ends`` binary (likewise: where each token's bytes end in the UTF-8 text).

    A null or empty text has no tokens; texts of any length are encoded whole, repeated
    rows stay repeated. Columns with those names give way, in either case.
    """
    rest = fresh(docs, "token_ids", "token_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        sizes = np.zeros(max(ids_of.ranks.values()) + 1, np.uint32)
        for piece, rank in ids_of.ranks.items():
            sizes[rank] = len(piece)
        for batch in chunks(batches, text, ENCODED):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = list(encode_texts(texts, ids_of))
            extra = [("token_ids", pa.binary(), pa.array(ids, pa.binary()))]
            if offsets:
                extra.append(("token_ends", pa.binary(), pa.array([np.cumsum(sizes[np.frombuffer(x, "<u4")], dtype="<u4").tobytes() for x in ids], pa.binary())))
            yield with_columns(batch, extra)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, token_ids binary" + ", token_ends binary" * offsets)


def cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    """The bytes of each token, by where they end."""
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", ends: str | None = "token_ends") -> DataFrame:
    """tokens with ``decoded`` binary: the bytes the ids stand for (null ids: empty).

    Where there is a column of offsets (``ends``), every token's bytes go where it says: a row
    whose offsets don't fit its ids raises an error.
    """
    rest = fresh(tokens, "decoded")
    offsets = ends if ends in rest.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, starts, sizes = decoder(path)
        for batch in chunks(batches, ids):
            found = [np.frombuffer(x, "<u4") for x in text_bytes(batch, ids)]
            if offsets:
                stated = [np.frombuffer(x, "<u4") for x in text_bytes(batch, offsets)]
                decoded = [placed(pieces, starts, sizes, x, e) for x, e in zip(found, stated, strict=True)]
            else:
                decoded = [placed(pieces, starts, sizes, x, np.cumsum(sizes[x])) for x in found]
            yield with_columns(batch, [("decoded", pa.binary(), pa.array(decoded, pa.binary()))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, decoded binary")


def digests(tokens: DataFrame) -> DataFrame:
    """The columns of an encoded and decoded table as digests."""
    return tokens.withColumns({"n_tokens": (F.length("token_ids") / 4).cast("long"), "ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2("decoded", 256)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = encode(docs, path).select("doc_id", "token_ids", "token_ends")
    return digests(decode(tokens, path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op1_bpe": query}
