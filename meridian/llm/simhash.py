"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped by correlation into m parts of about equal width.
Two fingerprints within ``distance`` bits of each other are, for any thresholds t_1..t_m
with t_1+...+t_m = distance-m+1, within t_i bits in at least one part i (a part with
t_i = -1 is never probed). Dynamic programming picks the thresholds, and a scan over m
the number of parts, from candidate counts estimated on the bit statistics of all
fingerprints. Each fingerprint is then filed under its value in each probed part and under
all values within half of that part's threshold (rounded up), so that two within the
threshold meet half way; what shares a file is compared in full.

near_duplicates() links fingerprints alone. similar_texts() plans for a similarity of the
texts: it links by fingerprints of five-word shingles at a distance that most pairs of that
similarity keep, and lets only links stand whose texts have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import chunks, fresh, hot_values, small_batches, spread_join, stored, table, text_bytes, with_columns

BITS = 64
#: A file with more fingerprints is compared in blocks of this many, by several tasks.
BLOCK = 4096
#: What comparing two fingerprints costs against filing one.
PAIR_COST = 0.01
#: Plans are made for so many fingerprints at least, so that small tables are filed as larger ones are.
PLANNED = 1_000_000
#: rows (a digest, an id and some numbers, about 100 bytes) that are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 200_000
#: Similarity that similar_texts() asks for, width of its shingles, and the most bits that may
#: differ in the fingerprint and in a second one (of 64 bits each; at a similarity of 0.8
#: about 10 differ in either).
SIMILAR, WIDE, REACH, CHECK = 0.8, 5, 11, 20
#: Bytes of shingle hashes, and texts, that are verified together.
VERIFIED, MEMBERS = 1 << 22, 1024
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included (fewer words: the whole sequence; none: none)."""
    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()][:n]
    ends = [*gaps.tolist(), len(joined)][min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 of word shingles; 0 without words."""
    return majority(shingles(text, width, seed))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """docs without the text, with ``fp`` long (the fingerprint's bits, as two's complement).

    A null or empty text has fingerprint zero. A column that is named fp gives way.
    """
    rest = fresh(docs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            fps = np.array([fingerprint(x, width) for x in text_bytes(batch, text)], np.uint64).view(np.int64)
            yield with_columns(batch, [("fp", pa.int64(), pa.array(fps))], without=(text,))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text)
    return rest.mapInArrow(run, ", ".join(x for x in (schema, "fp long") if x))


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j set, for all i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _unpacked(batch.column(0).to_numpy()).astype(np.float32)
            both += x.T @ x
            n += len(x)
        at, to = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at * BITS + to, -1]), pa.array(np.r_[both[at, to], n].astype(np.int64))], names=["cell", "n"])

    rows = classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for cell, count in rows:
        if cell < 0:
            n = count
        else:
            both[cell // BITS, cell % BITS] = both[cell % BITS, cell // BITS] = count
    return n, both


def _reach(disagree: np.ndarray, most: int) -> np.ndarray:
    """P(at most t of independent bits differ) for t = 0..most."""
    p = np.zeros(most + 1)
    p[0] = 1.0
    for q in disagree:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return np.cumsum(p)


def plan(n: int, both: np.ndarray, distance: int = 3) -> list[tuple[list[int], int]]:
    """Parts (bit positions) with their thresholds, of least estimated cost."""
    n1 = max(n, 1)
    p = np.diag(both) / n1
    size = max(n, PLANNED)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    linked = np.abs(both / n1 - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, distance + 3):
        parts, free = [], set(range(BITS))
        for i in range(m):
            room = len(free) // (m - i)
            part = [max(free, key=lambda b: (linked[b, list(free)].sum(), -b))]
            free.discard(part[0])
            while len(part) < room:
                part.append(max(free, key=lambda b: (linked[b, part].sum(), -b)))
                free.discard(part[-1])
            parts.append(sorted(part))

        def cost(part: list[int], t: int) -> float:
            if t < 0:
                return 0.0
            # bits that vary together count as fewer independent ones
            alike = 1 + linked[np.ix_(part, part)].sum() / len(part)
            reach = _reach(2 * p[part] * (1 - p[part]), t)[t] ** (1 / alike)
            # those that differ by t meet as often as there are halves of t
            return size * sum(comb(len(part), k) for k in range((t + 1) // 2 + 1)) + PAIR_COST * size * size / 2 * reach * comb(t, t // 2)

        # least cost of the first parts with thresholds that sum to s, and the thresholds
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            grown: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in table_.items():
                for t in range(-1, distance + 1):
                    new = (c + cost(part, t), [*chosen, t])
                    if s + t not in grown or new < grown[s + t]:
                        grown[s + t] = new
            table_ = grown
        c, chosen = table_[distance - m + 1]
        if best is None or c < best[0]:
            best = (c, list(zip(parts, chosen, strict=True)))
    return best[1]


def _files(classes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, node, fp, check, off): each fingerprint under its own value (off 0) and those near it (off bits away)."""
    probes = [(i, bits, [(sum(1 << b for b in flips), k) for k in range((t + 1) // 2 + 1) for flips in combinations(range(len(bits)), k)]) for i, (bits, t) in enumerate(parts) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                node, fps, check = (batch.column(i).slice(at, 4096).to_numpy() for i in range(3))
                bits = _unpacked(fps)
                for i, chosen, masks in probes:
                    value = bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))
                    for few in range(0, len(masks), 64):
                        mask, off = np.array(masks[few : few + 64], np.int64).T
                        keys = (value[:, None] ^ mask[None, :]).ravel()
                        more = [pa.array(np.repeat(x, len(mask))) for x in (node, fps, check)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), *more, pa.array(np.tile(off.astype(np.int32), len(fps)))],
                            names=["part", "key", "node", "fp", "check", "off"],
                        )

    return classes.select("node", "fp", "check").mapInArrow(run, "part int, key long, node long, fp long, check long, off int")


def _forest(group: np.ndarray, matching) -> tuple[list[int], list[int]]:
    """Places (left, right) of links within runs of equal ``group``, less those that links found before imply.

    matching(at, step) gives which pairs (at, at + step) link; it is asked only about pairs
    that no links connect so far.
    """
    n = len(group)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    label, at, step = np.arange(n), np.arange(n), 1
    left: list[int] = []
    right: list[int] = []
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        open_ = at[label[at] != label[at + step]]
        hit = matching(open_, step) if len(open_) else open_
        for i in hit.tolist():
            a, b = i, i + step
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        if len(hit):
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
        step += 1
    return left, right


def _hung(node: np.ndarray, left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    """Links (places in node) as pairs of each node and the least node that they connect it to."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in zip(node[left].tolist(), node[right].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return list(up), [top(x) for x in list(up)]


def _apart(x: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    return np.bitwise_count((x[at] ^ x[at + step]).view(np.uint64))


def _by_group(keys: int, compare):
    """Task function over rows sorted by their first ``keys`` columns: streams them, whole groups at a time.

    compare(group, columns) gives the links (a, b) of rows numbered by group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def linked(rows: pa.Table) -> pa.RecordBatch:
            columns = [rows.column(i).to_numpy() for i in range(rows.num_columns)]
            change = np.any([k[1:] != k[:-1] for k in columns[:keys]], axis=0)
            a, b = compare(np.r_[0, np.cumsum(change)], columns)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            last = [held.column(i)[-1].as_py() for i in range(keys)]
            first = [batch.column(i)[0].as_py() for i in range(keys)]
            if first == last:  # the last group fills the batch
                if [held.column(i)[0].as_py() for i in range(keys)] == last:
                    continue
            same = np.all([held.column(i).to_numpy() == v for i, v in enumerate(last)], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1
            yield linked(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield linked(held)

    return run


def links(classes: DataFrame, distance: int = 3, check: int | None = None) -> DataFrame:
    """(a, b): pairs of nodes that connect exactly what pairs within ``distance`` bits connect.

    classes: node, fp, check (longs; nodes distinct). With ``check``, the second fingerprints
    must be within that many bits as well. Within a file a pair is left out only if links
    found before connect its ends, and the rest hang on their least node, so components stay exact. A file with more than BLOCK
    fingerprints is dealt as pairs of blocks to several tasks.
    """
    parts = plan(*bit_statistics(classes), distance)
    thresholds = np.array([t for _, t in parts])
    files = _files(classes, parts)
    large = files.groupBy("part", "key").count().filter(F.col("count") > BLOCK).select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = stored(large, "large-files")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = files.join(large, ["part", "key"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["part", "key", "lo", "hi"]
    dealt = dealt.select("part", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "fp", "check", "off")

    def compare(group: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        part, _, _, _, node, fp, second, off = columns
        most = thresholds[part]

        def matching(at: np.ndarray, step: int) -> np.ndarray:
            ok = (off[at] + off[at + step] <= most[at]) & (_apart(fp, at, step) <= distance)
            at = at[ok]
            return at if check is None else at[_apart(second, at, step) <= check]

        return _hung(node, *_forest(group, matching))

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_by_group(4, compare), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): documents linked through fingerprints at ``distance`` bits or fewer.

    component_id is the smallest id reachable (null only where every id reachable is null).
    Equal fingerprints are one class, so exact copies make no pairs. Repeated rows stay
    repeated; an empty table gives an empty result; null texts have fingerprint zero; texts
    of any length are read whole. Other columns, whatever their names, don't take part.
    """
    printed = stored(fingerprints(docs.select(doc_id, text), text), "fingerprints")
    classes = stored(printed.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("n")), "classes")
    nodes = classes.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("check"))
    groups = grouped(classes.select(F.col("fp").alias("node"), "least"), links(nodes, distance))
    named = groups.select(F.col("node").alias("fp"), F.col("group_least").alias("component_id"))
    return spread_join(printed, named, "fp", hot_values(classes, "fp", "n")).select(doc_id, "fp", "component_id")


def grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, group_least): the group of each node (node, least), and the least ``least`` in it."""
    roots = components(edges, "a", "b")
    linked = stored(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "linked")
    sizes = stored(linked.groupBy("root").agg(F.min("least").alias("group_least"), F.count("*").alias("n")), "groups")
    return spread_join(linked.drop("least"), sizes.drop("n"), "root", hot_values(sizes, "root", "n"))


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Is the Jaccard similarity of two sorted sets so large? Empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (small + large - both) - 1e-9


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """texts (root, node, fp, check, text) with the sorted distinct shingle hashes instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes = [np.unique(shingles(x, width)).tobytes() for x in text_bytes(batch)]
            yield with_columns(batch, [("hashes", pa.binary(), pa.array(hashes, pa.binary()))], without=("text",))

    return texts.select("root", "node", "fp", "check", "text").mapInArrow(run, "root long, node long, fp long, check long, hashes binary")


def verified_links(sets: DataFrame, distance: int, check: int, similarity: float) -> DataFrame:
    """(a, b): pairs that connect exactly what links within the groups (root) connect that hold on the shingles.

    A group of more than VERIFIED bytes or MEMBERS texts is dealt as pairs of blocks to several
    tasks. Pairs that verified links connect already aren't compared again.
    """
    parts = F.greatest(F.ceil(F.sum(F.length("hashes") + 64) / VERIFIED), F.ceil(F.count("*") / MEMBERS))
    large = stored(sets.groupBy("root").agg(parts.cast("int").alias("blocks")).filter("blocks > 1"), "large-groups")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = sets.join(large, "root", "left").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "fp", "check", "hashes")

    def compare(group: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, low, high, own, node, fp, second, hashes = columns
        found = [np.frombuffer(x, np.uint64) for x in hashes]

        def matching(at: np.ndarray, step: int) -> np.ndarray:
            # two of one block are compared where that block is alone
            ok = ((own[at] != own[at + step]) | (low[at] == high[at])) & (_apart(fp, at, step) <= distance)
            at = at[ok]
            at = at[_apart(second, at, step) <= check]
            return at[np.array([_alike(found[i], found[i + step], similarity) for i in at.tolist()], bool)]

        return _hung(node, *_forest(group, matching))

    keys = ["root", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp", "node").mapInArrow(_by_group(3, compare), "a long, b long")


def text_key(text: str = "text"):
    """Digest of a whole text; null counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDE, similarity: float = SIMILAR, distance: int = REACH, check: int = CHECK) -> DataFrame:
    """(doc_id, key, group): rows of docs grouped by the similarity of their texts.

    Two texts are linked if the fingerprints of their ``width``-word shingles differ in at
    most ``distance`` bits, second ones in at most ``check``, and the sets of shingles have
    that Jaccard similarity. Equal texts (key: their digest) are one node; group is a number
    that linked texts share. Null texts are empty, and texts without words are alike. Pairs
    of the similarity whose fingerprints differ more are missed unless others link them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = [shingles(x, width) for x in text_bytes(batch, text)]
            pairs = np.array([(majority(h), majority(mixed(h))) for h in found], np.uint64).reshape(-1, 2).view(np.int64)
            yield with_columns(batch, [("fp", pa.int64(), pa.array(pairs[:, 0].copy())), ("check", pa.int64(), pa.array(pairs[:, 1].copy()))], without=(text,))

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(doc_id, text_key(text).alias("key"), text)
    printed = stored(keyed.mapInArrow(run, f"`{doc_id}` {kind}, key string, fp long, check long"), "fingerprints")
    classes = printed.groupBy("key").agg(F.min(doc_id).alias("least"), F.first("fp").alias("fp"), F.first("check").alias("check"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    near = components(links(classes, distance, check), "a", "b")
    members = stored(classes.join(near, "node").select("root", "node", "fp", "check", F.col("key").alias("own"), "least"), "members")
    # of equal texts that with the least id is fetched, of its repetitions one
    few = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = keyed.join(few, (F.col("key") == F.col("own")) & F.col(doc_id).eqNullSafe(F.col("least"))).select("root", "node", "fp", "check", F.coalesce(text, F.lit("")).alias("text"))
    sets = stored(_sets(texts, width).dropDuplicates(["node"]), "sets")
    groups = grouped(classes.select("node", "least"), verified_links(sets, distance, check, similarity))
    named = stored(classes.join(groups, "node").select("key", F.col("root").alias("group")), "named")
    return spread_join(printed.select(doc_id, "key"), named, "key", hot_values(classes, "key", "n"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": query}
