"""Token counts by a two-tier look-up, without shuffling pre-tokens.

Texts are normalised and cut into pre-tokens as the tokenizer's file says; a text's count is
the sum of its pre-tokens' lengths in tokens. The lengths of the most frequent pre-tokens
come in a broadcast table (at most FREQUENT entries of at most LONGEST characters, which
bounds it to a few MB); a pre-token that isn't there is encoded by the library once and kept
in the worker's cache. As no pre-token reaches over white space, a second cache keeps the
sums of whole words, so a word is cut into pre-tokens once.

Which pre-tokens are frequent only decides how fast a count is, never what it is, so the
table is chosen from a bounded sample: the SAMPLE texts of lowest hash. Their pre-tokens
are counted by a few tasks, which hand on packed lists; no pre-token is a key of a shuffle.

Code points whose kind differs between versions of Unicode are left to the library, but
only the words (between white space and special tokens) that hold one; each such word is
encoded once and kept in a cache of its own.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh, one_row_per, table, with_columns

VOCABULARY = "word_bpe_49k.json"
FREQUENT, LONGEST = 1 << 16, 64
#: texts that the table is chosen from, and tasks that count them
SAMPLE, COUNTERS = 4000, 8
#: words that a task counts at once, and entries that each of a worker's caches holds
COUNTED, CACHED = 200_000, 350_000
LIMIT = 2048


def _ranges(points: list[int]) -> str:
    out, begin = [], None
    for p in [*points, None]:
        if begin is not None and p != last + 1:  # noqa: F821
            out.append(f"\\U{begin:08x}-\\U{last:08x}")  # noqa: F821
            begin = p
        elif begin is None:
            begin = p
        last = p  # noqa: F841
    return "".join(out)


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern, frozenset[str]]:
    """Pre-tokens of lowered text; white space; the code points that aren't left to the library.

    The letters and numbers that Unicode 3.2 knew, and that are so still, are the same in
    every library; a word with any newer or changed code point is counted by the library.
    """
    old, kinds = unicodedata.ucd_3_2_0, {}
    for c in range(0x110000):
        now, then = unicodedata.category(chr(c)), old.category(chr(c))
        kinds[c] = now[0] if now[0] in "LN" else "O"
        # the separators 1C to 1F are white space to str.split alone
        if then == "Cn" or (then[0] in "LN") != (now[0] in "LN") or now == "Cs" or 0x1C <= c <= 0x1F:
            kinds[c] = "new"
    letters, numbers = (_ranges([c for c, k in kinds.items() if k == kind]) for kind in "LN")
    # The contractions and the other alternatives.
    blank = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    piece = re.compile(f"[a-z]+(?![{letters}])|[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{blank}{letters}{numbers}]+")
    return piece, re.compile(f"[{blank}]+"), frozenset(chr(c) for c, k in kinds.items() if k != "new")


class Counting(dict):
    """Tokens by word (what stands between white space), for one tokenizer file."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as lines:
            own = json.load(lines)
        self.special = [x["content"] for x in own["added_tokens"]]
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in own["added_tokens"]):
            raise ValueError("only plain special tokens are supported")
        self.divider = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.library = tokenizers.Tokenizer.from_file(path)
        bare = own | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.bare = tokenizers.Tokenizer.from_str(json.dumps(bare))
        self.piece, self.blank, self.safe = _patterns()
        #: the broadcast table and which broadcast it is of
        self.frequent: dict[str, int] = {}
        self.taken: int | None = None
        self.rare: dict[str, int] = {}
        self.odd: dict[str, int] = {}

    def take(self, number: int, table: tuple[str, bytes]) -> None:
        """Use a broadcast table; unpacked once a worker."""
        if number != self.taken:
            self.frequent, self.taken = dict(zip(table[0].split("\n"), table[1], strict=False)), number

    def __missing__(self, word: str) -> int:
        n = sum(map(self.length, self.piece.findall(word)))
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def length(self, piece: str) -> int:
        """Tokens of a pre-token: from the table, the cache, or the library."""
        n = self.frequent.get(piece) or self.rare.get(piece)
        if n is None:
            n = len(self.bare.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= LONGEST:
                self.rare[piece] = n
        return n

    def words(self, text: str) -> tuple[list[str], list[str], int]:
        """Lowered words, the words left to the library as they are, and the number of special tokens."""
        if text.isascii() and not ("<" in text and self.divider.search(text)) and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
            return text.lower().split(), [], 0
        parts, found, odd = self.divider.split(text), [], []
        for part in parts:
            if not self.safe.issuperset(part):
                own = self.blank.split(part)
                odd += [w for w in own if not self.safe.issuperset(w)]
                part = " ".join(w for w in own if self.safe.issuperset(w))
            # lower() writes a final sigma; the library lowers characters one by one
            found += unicodedata.normalize("NFC", part).replace("Σ", "σ").lower().split()
        return found, odd, len(parts) - 1

    def by_library(self, word: str) -> int:
        n = self.odd.get(word)
        if n is None:
            n = len(self.library.encode(word, add_special_tokens=False).ids)
            if len(word) <= LONGEST:
                self.odd[word] = n
        return n

    def count(self, text: str) -> int:
        found, odd, special = self.words(text)
        return sum(map(self.__getitem__, found)) + sum(map(self.by_library, odd)) + special

    def trim(self) -> None:
        for kept in (self, self.rare, self.odd):
            if len(kept) > CACHED:
                kept.clear()


@functools.cache
def counting(path: str) -> Counting:
    return Counting(path)


def frequent(docs: DataFrame, path: str, text: str = "text") -> list[tuple[str, int]]:
    """The most frequent pre-tokens of the sampled texts with their lengths in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = counting(path), Counter()
        for batch in chunks(batches, text):
            for t in batch.column(0).to_pylist():
                seen.update(own.words(t)[0])
            if len(seen) > COUNTED:  # those seen least give way
                seen = Counter(dict(seen.most_common(COUNTED // 2)))
        pieces: Counter[str] = Counter()
        for word, n in seen.items():
            for piece in own.piece.findall(word):
                pieces[piece] += n
        top = [(p, n) for p, n in pieces.most_common(FREQUENT) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(p for p, _ in top)], pa.string()), pa.array([np.array([n for _, n in top], np.int64).tobytes()], pa.binary())], names=["pieces", "n"])

    hashed = docs.filter(F.length(text) > 0).select(F.col(text), F.xxhash64(text).alias("hash"))
    picked = hashed.select(F.col("hash").alias("picked")).orderBy("picked").limit(SAMPLE)
    sample = one_row_per(hashed, picked, "hash", text).select(text).repartition(COUNTERS)
    total: Counter[str] = Counter()
    for r in sample.mapInArrow(run, "pieces string, n binary").collect():
        if r.pieces:
            total.update(dict(zip(r.pieces.split("\n"), np.frombuffer(r.n, np.int64).tolist(), strict=True)))
    pieces = sorted(p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT])
    own = counting(path)
    return [(p, own.length(p)) for p in pieces]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with ``n_bytes``, ``n_tokens`` and ``over_limit``; a null text counts as empty.

    Texts of any length are counted whole, repeated rows stay repeated. Columns with those
    names give way, in either case.
    """
    rest = fresh(docs, "n_bytes", "n_tokens", "over_limit")
    entries = frequent(docs, path, text)
    # compact: one string and a byte an entry (no pre-token of 64 characters has over 255 tokens)
    shared = docs.sparkSession.sparkContext.broadcast(("\n".join(p for p, _ in entries), np.array([n for _, n in entries], np.uint8).tobytes()))

    number = zlib.crc32(shared.value[0].encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counting(path)
        own.take(number, shared.value)
        for batch in chunks(batches, text):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n = [own.count(t) for t in texts]
            own.trim()
            extra = [("n_bytes", pa.int64(), [len(t.encode()) for t in texts]), ("n_tokens", pa.int64(), n), ("over_limit", pa.bool_(), [x > limit for x in n])]
            yield with_columns(batch, extra)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op6_token_counts": query}
