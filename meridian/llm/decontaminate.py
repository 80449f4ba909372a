"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark text of n words has n-9 windows of 10 words (a shorter one is a window
itself). A document can only contain a window if it contains all of its shingles, one
after another. So

1. the shingles of all windows of a length go into a bitmap of bounded size, and one pass
   over the documents keeps only stretches of consecutive shingles that pass it and are long
   enough for a window (most documents have none);
2. equal stretches become one; shingles are ordered by how often all documents hold them
   there, and a window's prefix is its rarest (a window with a shingle that no document has
   occurs nowhere);
3. stretches are joined to windows on the prefix alone; the shingle's offset gives where
   the window would begin (positional bound), the stretch's ends whether it fits (length
   bound), and what is left is compared word by word.

Benchmark, windows, prefixes and stretches are all distributed tables, so either side may
be large; only the bitmaps (at most MOST_BITS each, one for each window length) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh, hot_values, spread_join, stored, table, text_bytes

WINDOW = 10
WIDTH = 3
#: bits of a bitmap: so many a shingle, a power of two between these
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 1 << 12, 1 << 26
#: bits of a bitmap that are put together by one task
PART = 1 << 18
#: hashes of words that a worker keeps
CACHED = 60_000
#: bytes of results by row (a number, spans and ids) that are broadcast; more are joined by a shuffle
BROADCAST_BYTES = 8 << 20
#: ASCII letters and digits and all bytes above 127 are word bytes; the rest divides words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
RESULTS = ("n_words", "n_hit", "spans", "items")
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Hashes(dict):
    """64-bit hashes of words, kept once computed."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) | 1
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` consecutive words, by their first."""
    n = max(0, len(hashes) - width + 1)
    key = np.full(n, width, np.uint64)
    for j in range(width):
        key = (key ^ hashes[j : j + n]) * FACTOR
        key ^= key >> np.uint64(29)
    return key


def width_of(length: int) -> int:
    """Width of the shingles of windows of a length."""
    return min(length, WIDTH)


def windows(texts: DataFrame, window: int) -> DataFrame:
    """(text_key, win, length, shingles): the windows of each text (text_key, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in chunks(batches, "item", 1 << 18):
            rows: list[list] = [[], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch, "item"), strict=True):
                words = words_of(text)
                if not words:
                    continue
                length = min(window, len(words))
                found = shingles(known.of(words), width_of(length)).view(np.int64)
                for i in range(len(words) - length + 1):
                    rows[0].append(key)
                    rows[1].append(b" ".join(words[i : i + length]).decode())
                    rows[2].append(length)
                    rows[3].append(found[i : i + length - width_of(length) + 1])
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["text_key", "win", "length", "shingles"])

    return texts.select("text_key", "item").mapInArrow(run, "text_key string, win string, length int, shingles array<long>")


def bitmaps(wins: DataFrame) -> dict[int, np.ndarray]:
    """By window length, the bits (bytes of 0 or 1, packed) of all shingles of its windows.

    The parts of a bitmap are made by tasks; what reaches the driver is at most MOST_BITS
    for each length.
    """
    each = wins.select("length", F.explode("shingles").alias("s")).distinct()
    sizes = {r.length: min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * r.n - 1).bit_length())) for r in each.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    bits = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("length")).cast("long")
    slots = each.select("length", F.pmod("s", bits).alias("slot")).distinct().select("length", F.floor(F.col("slot") / PART).cast("int").alias("part"), (F.col("slot") % PART).cast("int").alias("at"))

    def put(rows: pa.Table) -> pa.Table:
        mark = np.zeros(PART, bool)
        mark[rows.column("at").to_numpy()] = True
        return pa.table({"length": rows.column("length").slice(0, 1), "part": rows.column("part").slice(0, 1), "bits": pa.array([np.packbits(mark, bitorder="little").tobytes()], pa.binary())})

    out = {length: np.zeros(max(n, PART) // 8, np.uint8) for length, n in sizes.items()}
    for r in slots.groupBy("length", "part").applyInArrow(put, "length int, part int, bits binary").collect():
        out[r.length][r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.bits, np.uint8)
    return {length: b[: max(1, sizes[length] // 8)] for length, b in out.items()}


def _stretches(hashes: np.ndarray, bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (in hashes) of the stretches whose shingles all pass and which can hold a window.

    A zero among the hashes stands between texts.
    """
    width = width_of(length)
    key = shingles(hashes, width)
    slot = key & np.uint64(len(bits) * 8 - 1)
    ok = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
    for j in range(width):
        ok &= hashes[j : j + len(key)] != 0
    edge = np.diff(np.r_[False, ok, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_enough = end - begin >= length - width + 1
    return begin[long_enough], end[long_enough] + width - 1


SEGMENT = pa.struct([("length", pa.int32()), ("start", pa.int32()), ("words", pa.string())])


def scanned(docs: DataFrame, maps: dict[int, np.ndarray], text: str, keep_text: bool) -> DataFrame:
    """docs with _row (a number that stays, as the table is written), n_words and _segments (length, start, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    keep = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = Hashes(), TaskContext.get().partitionId() << 33
        for batch in chunks(batches, text, 1 << 19):
            lists = [words_of(t) for t in text_bytes(batch, text)]
            sizes = np.array([len(x) for x in lists], np.int64)
            first = np.cumsum(sizes + 1) - sizes - 1
            hashes = np.zeros(int((sizes + 1).sum()), np.uint64)
            for at, words in zip(first.tolist(), lists, strict=True):
                hashes[at : at + len(words)] = known.of(words)
            found: list[list[dict]] = [[] for _ in lists]
            for length, bits in shared.value.items():
                begin, end = _stretches(hashes, bits, length)
                owner = np.searchsorted(first, begin, side="right") - 1
                for i, a, b in zip(owner.tolist(), (begin - first[owner]).tolist(), (end - first[owner]).tolist(), strict=True):
                    found[i].append({"length": length, "start": a, "words": b" ".join(lists[i][a:b]).decode()})
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(range(row, row + batch.num_rows), pa.int64()), pa.array(sizes), pa.array(found, pa.list_(SEGMENT))]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "_row", "n_words", "_segments"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return stored(docs.mapInArrow(run, f"{schema}_row long, n_words long, _segments array<struct<length:int,start:int,words:string>>"), "scanned")


def _positions(segments: DataFrame) -> DataFrame:
    """(seg, length, n, at, shingle): every shingle of the distinct stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in chunks(batches, "words", 1 << 18):
            seg, length, n = (batch.column(i).to_numpy() for i in range(3))
            found = [shingles(known.of(w.split(b" ")), width_of(k)).view(np.int64) for w, k in zip(text_bytes(batch, "words"), length.tolist(), strict=True)]
            sizes = np.array([len(x) for x in found])
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            arrays = [pa.array(np.repeat(x, sizes)) for x in (seg, length, n)] + [pa.array(at.astype(np.int32)), pa.array(np.concatenate(found))]
            yield pa.RecordBatch.from_arrays(arrays, names=["seg", "length", "n", "at", "shingle"])

    return segments.select("seg", "length", "n", "words").mapInArrow(run, "seg long, length int, n long, at int, shingle long")


def _united(spans: Column) -> Column:
    """Sorted spans (start, end) with those that touch made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPANS), add)


def _spans(start: Column, end: Column) -> Column:
    return _united(F.array_sort(F.collect_set(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))))


def _hits(segments: DataFrame, wins: DataFrame) -> DataFrame:
    """(seg, at, length, win): every occurrence of a window in the distinct stretches."""
    places = stored(_positions(segments), "positions")
    counts = places.groupBy("length", "shingle").agg(F.sum("n").alias("n"))
    parts = wins.select("win", "length", F.posexplode("shingles").alias("offset", "shingle")).join(counts, ["length", "shingle"])
    rarest = parts.groupBy("win", "length").agg(F.count("*").alias("k"), F.min(F.struct("n", "offset", "shingle")).alias("p"))
    prefix = rarest.filter(F.col("k") == F.col("length") - F.least("length", F.lit(WIDTH)) + 1).select("win", "length", "p.offset", "p.shingle")
    prefix = stored(prefix, "prefixes")
    begin = F.col("at") - F.col("offset")
    fits = places.join(prefix, ["length", "shingle"]).filter(begin >= 0).select("seg", begin.alias("at"), "length", "win")
    words = segments.select("seg", F.split("words", " ").alias("words"))
    same = F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ") == F.col("win")
    return fits.join(words, "seg").filter((F.col("at") + F.col("length") <= F.size("words")) & same).select("seg", "at", "length", "win")


def _key() -> Column:
    """A digest of a stretch and the length of its windows."""
    return F.md5(F.concat_ws(" ", "length", "words").cast("binary"))


def found_in(rows: DataFrame, items: DataFrame, wins: DataFrame) -> DataFrame:
    """(_row, n_hit, spans, items) of the rows of scanned() with an occurrence."""
    placed = rows.filter(F.size("_segments") > 0).select("_row", F.explode("_segments").alias("s")).select("_row", "s.*")
    segments = placed.groupBy("length", "words").agg(F.count("*").alias("n")).withColumn("seg", F.monotonically_increasing_id())
    segments = stored(segments.withColumn("key", _key()), "stretches")
    hits = stored(_hits(segments, wins.dropDuplicates(["win"])), "hits")
    spans = hits.groupBy("seg").agg(_spans(F.col("at"), F.col("at") + F.col("length")).alias("inside"))
    texts = hits.select("seg", "win").distinct().join(wins.select("win", "text_key"), "win").groupBy("seg").agg(F.collect_set("text_key").alias("texts"))
    verdicts = stored(segments.join(spans, "seg").join(texts, "seg").select("key", "n", "inside", "texts"), "verdicts")
    # a passage may be in a third of the documents; what is shuffled for each is a digest
    keyed = placed.select("_row", "start", _key().alias("key"))
    own = spread_join(keyed, verdicts.drop("n"), "key", hot_values(verdicts, "key", "n")).select("_row", "start", "inside", "texts")
    covered = own.select("_row", F.explode("inside").alias("s"), "start").groupBy("_row").agg(_spans(F.col("start") + F.col("s.start"), F.col("start") + F.col("s.end")).alias("spans"))
    # item ids are listed once for each set of texts, however many rows have it
    sets = stored(own.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("texts")))).alias("texts")), "text-sets")
    ids = sets.select("texts").distinct().select("texts", F.explode("texts").alias("text_key")).join(items.select("text_key", "id"), "text_key")
    ids = ids.groupBy("texts").agg(F.array_sort(F.collect_set("id")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return covered.join(sets, "_row").join(ids, "texts").select("_row", n_hit.alias("n_hit"), "spans", "items")


def contained(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """docs (with their text, if asked for) and

    - n_words: words of the text; n_hit: words inside any occurrence of a benchmark window;
    - spans: where those words are, as sorted (start, end) in words, end exclusive;
    - items: the items with occurring windows (ids as strings, sorted).

    Null and wordless texts have no words and no hits, as items without words have no
    windows. Repeated items count under each of their ids; a null id reads ``null``.
    Repeated rows stay repeated. Columns that are named as results give way, in either case.
    """
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("item")).filter(F.col("item").isNotNull())
    named = named.withColumn("text_key", F.sha2(F.col("item").cast("binary"), 256))
    wins = stored(windows(named.dropDuplicates(["text_key"]), window), "windows")
    ids = named.select("text_key", "id").distinct()
    rows = scanned(fresh(docs, *RESULTS, "_row", "_segments"), bitmaps(wins), text, keep_text)
    found = stored(found_in(rows, ids, wins), "found")
    ids_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 24)
    if found.agg(F.coalesce(F.sum(ids_bytes + F.size("spans") * 32 + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        found = F.broadcast(found)
    whole = rows.drop("_segments").join(found, "_row", "left").drop("_row")
    return whole.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids, (F.col("n_hit") > 0).alias("contaminated"))


SQL = """
with texts as (
  select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), words as (
  select r, doc_id, list_filter(regexp_split_to_array(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from texts
), named as (
  select distinct coalesce(item_id::varchar, 'null') as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from benchmark where text is not null
), split as (
  select id, list_filter(regexp_split_to_array(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from named
), places as (
  select id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from split where len(w) > 0
), wins as (
  select distinct id, n, array_to_string(w[i:i+n-1], ' ') as win from places
), lengths as (
  select distinct n from wins
), spots as (
  select r, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n
), hits as (
  select r, i, n, win from (select r, i, n, array_to_string(w[i:i+n-1], ' ') as win from spots) semi join wins using (n, win)
), covered as (
  select r, count(distinct word) as n_hit from (select r, unnest(range(i, i + n)) as word from hits) group by r
), occurring as (
  select r, list_sort(list(distinct id)) as ids from (select distinct r, n, win from hits) join wins using (n, win) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (r) left join occurring using (r)
"""

QUERIES = {"op4_decontaminate": query}
ORACLES = {"op4_decontaminate": SQL}
