"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation and turn over all partitions (by range, so that a
conversation with very many turns is spread). A batch's formatted text is put together in
numpy: lengths of all segments (marks, roles, contents, escapes), their cumulative offsets,
and scatter indices by which headers and contents are copied into one preallocated Arrow
buffer. A row of the result is a chunk: consecutive turns of one conversation, with the
code points that the loss mask covers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, table

#: bytes of a piece of output whose indices are computed at once
WINDOW = 1 << 20


@dataclass(frozen=True)
class Template:
    """begin, role, separator, content, end for each turn.

    Control strings inside roles and contents get one ``escape`` after their first character
    (one more, if there are some already), so that only marks read as marks and reading back
    takes one away. First characters of control strings may not come again in any of them.
    """

    begin: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if not self.escape.isascii() or len(self.escape) != 1 or not all(c.isascii() and len(c) > 1 for c in self.controls):
            raise ValueError("escape must be one ASCII character, control strings longer ASCII strings")
        if any(x in firsts or x == self.escape for c in self.controls for x in c[1:]) or self.escape in firsts:
            raise ValueError("first characters of control strings, and the escape, may not come again in them")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.separator, self.end, *self.others)

    def unescape(self, text: str) -> str:
        """The text without the escapes that formatting put in."""
        if self.escape not in text:
            return text
        e = re.escape(self.escape)
        tails = "|".join(f"{re.escape(c[0])}{e}*(?={e}{re.escape(c[1:])})" for c in self.controls)
        # one escape, the last before a control string's rest, goes
        return re.sub(f"({tails}){e}", r"\1", text)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, content) of each turn of a formatted text."""
        b, s, e = (re.escape(x) for x in (self.begin, self.separator, self.end))
        out, at = [], 0
        for m in re.compile(f"{b}(.*?){s}(.*?){e}", re.DOTALL).finditer(formatted):
            if m.start() != at:
                break
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        if at != len(formatted):
            raise ValueError("text isn't formatted by this template")
        return out


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def escapes(data: np.ndarray, offsets: np.ndarray, template: Template) -> np.ndarray:
    """Where escapes belong: the places after the first character of each control string, sorted."""
    found = []
    plain = None
    for first in sorted({c[0] for c in template.controls}):
        at = np.flatnonzero(data == ord(first))
        if not len(at):
            continue
        row_end = offsets[np.searchsorted(offsets, at, side="right")]
        rest = at + 1
        stuffed = (rest < row_end) & (data[np.minimum(rest, len(data) - 1)] == ord(template.escape))
        if stuffed.any():
            plain = np.append(np.flatnonzero(data != ord(template.escape)), len(data)) if plain is None else plain
            rest[stuffed] = plain[np.searchsorted(plain, rest[stuffed])]
        for control in template.controls:
            if control[0] == first:
                tail = np.frombuffer(control[1:].encode(), np.uint8)
                fits = np.flatnonzero(rest + len(tail) <= row_end)
                for k, x in enumerate(tail):
                    fits = fits[data[rest[fits] + k] == x]
                found.append(at[fits] + 1)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, template: Template, slot: int, base: int, escape_at: int) -> list[np.ndarray]:
    """(row, slot, order, source, length) of a column's stretches between escapes, and of the escapes."""
    cuts = escapes(data, offsets, template)
    rows = len(offsets) - 1
    cut_row = np.searchsorted(offsets, cuts - 1, side="right") - 1  # the control's first character is in this row
    row = np.concatenate([np.arange(rows), cut_row])
    start = np.concatenate([offsets[:-1], cuts])
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    after = np.append(start[1:], offsets[-1])
    stop = np.where(np.append(row[1:] != row[:-1], True), offsets[row + 1], after)
    stretches = np.stack([row, np.full(len(row), slot), 2 * start + 1, start + base, stop - start])
    marks = np.stack([cut_row, np.full(len(cuts), slot), 2 * cuts, np.full(len(cuts), escape_at), np.ones(len(cuts), np.int64)])
    return [stretches, marks]


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer: (buffer, byte offsets of the turns, code points before each turn, content spans).

    Offsets have one more than there are turns; spans (2, turns) are code points of the content.
    """
    role, role_ends = _column(roles)
    text, text_ends = _column(texts)
    marks = [x.encode() for x in (template.begin, template.separator, template.end, template.escape)]
    at = np.cumsum([0, *map(len, marks)])
    pool = np.concatenate([np.frombuffer(b"".join(marks), np.uint8), role, text])
    n = len(role_ends) - 1
    rows, zero = np.arange(n), np.zeros(n, np.int64)
    fixed = [np.stack([rows, np.full(n, slot), zero, np.full(n, at[k]), np.full(n, len(marks[k]))]) for slot, k in ((0, 0), (2, 1), (4, 2))]
    pieces = _pieces(role, role_ends, template, 1, int(at[4]), int(at[3])) + _pieces(text, text_ends, template, 3, int(at[4]) + len(role), int(at[3]))
    row, slot, order, source, length = np.concatenate([*fixed, *pieces], axis=1)
    by = np.lexsort((order, slot, row))
    row, slot, source, length = row[by], slot[by], source[by], length[by]
    ends = np.cumsum(length)
    begins = ends - length
    total = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for lo in range(0, total, WINDOW):
        hi = min(total, lo + WINDOW)
        i, j = np.searchsorted(ends, lo, side="right"), np.searchsorted(begins, hi, side="left")
        size = np.minimum(ends[i:j], hi) - np.maximum(begins[i:j], lo)
        out[lo:hi] = pool[np.repeat(source[i:j] - begins[i:j], size) + np.arange(lo, hi)]
    # code points of each segment: bytes that don't continue one
    lead = np.append((out & 0xC0) != 0x80, False)
    points = np.where(length > 0, np.add.reduceat(lead, np.minimum(begins, total), dtype=np.int64), 0) if n else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(points)])
    first = np.searchsorted(row, np.arange(n + 1))
    turn_bytes = np.append(begins, total)[first]
    content = np.flatnonzero((slot == 3) & np.append(True, (slot[:-1] != 3) | (row[1:] != row[:-1]))) if n else zero
    return buffer, turn_bytes, before[first], np.stack([before[content], before[np.flatnonzero(slot == 4)]]) if n else np.zeros((2, 0), np.int64)


RESULT = ["conv_id", "part", "chunk", "whole", "turns", "formatted", "loss_from", "loss_to"]


def _chunk_rows(batch: pa.RecordBatch, template: Template) -> tuple[list, pa.Array]:
    """Arrays turns, formatted, loss_from, loss_to with a row for each run of equal ids; the runs' ids."""
    ids, roles = batch.column(0), batch.column(1)
    buffer, turn_bytes, points, spans = assemble(roles, batch.column(2), template)
    same = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    stop = np.append(start[1:], len(same))
    formatted = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(turn_bytes[start], turn_bytes[-1]).astype(np.int32)), buffer)
    masked = np.flatnonzero(np.isin(np.array(roles.to_pylist(), object), template.loss_roles))
    run = np.searchsorted(start, masked, side="right") - 1
    offsets = pa.array(np.searchsorted(masked, np.append(start, len(same))).astype(np.int32))
    shift = points[start][run]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(spans[k, masked] - shift, pa.int64())) for k in (0, 1)]
    return [pa.array((stop - start).astype(np.int64)), formatted, *lists], ids.take(pa.array(start))


def format_chats(
    conversations: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, part, chunk, whole, turns, formatted, loss_from, loss_to): formatted conversations.

    Chunks of a conversation in order of (part, chunk), joined, are its formatted text; one
    that is ``whole`` is all of it (a conversation at the edge of a batch or partition may
    come as several, and all may be said not to be whole). loss_from and loss_to are the code
    points of the chunk between which the contents of loss roles are.

    Turns go by ``turn`` (null first), ties by role, then by a hash of the text; repeated rows
    are repeated turns. A null role or text counts as empty. Rows with a null id form one
    conversation. An empty table gives no rows; other columns don't matter.
    """
    small_batches(conversations.sparkSession)
    told = [F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn")]
    told += [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((role, "role"), (text, "text"))]
    # the number keeps repeated rows from meeting in one task
    keys = ["conv_id", "turn", "role", F.xxhash64("text"), "number"]
    rows = conversations.select(*told).withColumn("number", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, chunk = TaskContext.get().partitionId(), None, 0

        def put(ids: pa.Array, arrays: list, whole: np.ndarray) -> pa.RecordBatch:
            n = len(ids)
            numbers = pa.array(np.arange(chunk - n, chunk))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, part, np.int32)), numbers, pa.array(whole), *arrays], names=RESULT)

        for batch in chunks(batches):
            arrays, ids = _chunk_rows(batch, template)
            whole = np.ones(len(ids), bool)
            if held is None:
                whole[0] = False
            else:
                if held[0][-1] == ids[0]:
                    held[2][-1] = whole[0] = False
                yield put(*held)
            chunk += len(ids)
            held = ids, arrays, whole
        if held is not None:
            held[2][-1] = False
            yield put(*held)

    return rows.mapInArrow(run, f"conv_id {kind}, part int, chunk long, whole boolean, turns long, formatted string, loss_from array<long>, loss_to array<long>")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, part, chunk, position, role, text): the turns of format_chats()' chunks, in order of the three numbers."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k, *turn) for i, text in enumerate(batch.column(3).to_pylist()) for k, turn in enumerate(template.turns(text))]
            row, position, role, text = zip(*found, strict=True) if found else [()] * 4
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(at) for c in range(3)], pa.array(position, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string()),
            ], names=["conv_id", "part", "chunk", "position", "role", "text"])

    return formatted.select("conv_id", "part", "chunk", "formatted").mapInArrow(run, f"conv_id {kind}, part int, chunk long, position long, role string, text string")


DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from format_chats()' result.

    turns_sha256 is over role, line break, text, line break of every turn; the loss columns
    are over what the loss mask covers. A whole chunk is digested where it is; chunks of
    divided conversations go by id to a task that takes them one by one, as a digest can
    only be had in order.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            whole, texts, begins, ends = (batch.column(names.index(c)).to_pylist() for c in ("whole", "formatted", "loss_from", "loss_to"))
            out: list[list] = [[] for _ in range(7)]
            for done, text, begin, end in zip(whole, texts, begins, ends, strict=True):
                turns = template.turns(text)
                said = "".join(f"{role}\n{content}\n" for role, content in turns).encode()
                loss = "".join(template.unescape(text[i:j]) for i, j in zip(begin, end, strict=True))
                masked = loss.encode()
                digest = [hashlib.sha256(x).hexdigest() if done else None for x in (said, masked)]
                left = [None, None] if done else [said, masked]
                row = (len(turns), digest[0], len(loss), digest[1], len(text), *left)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            keys = ["conv_id", "part", "chunk"]
            arrays = [*(batch.column(names.index(c)) for c in keys), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *DIGESTS, "said", "masked"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, hashes = None, None, None

        def row() -> list:
            return [at, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]]

        for batch in batches:
            done = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                key, _, _, n, turns, chars, loss, size, said, masked = r
                if sums is not None and key != at:
                    done.append(row())
                    sums = None
                if said is None:
                    done.append([key, n, turns, chars, loss, size])
                    continue
                if sums is None:
                    at, sums, hashes = key, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                sums = [sums[0] + n, sums[1] + chars, sums[2] + size]
                hashes[0].update(said)
                hashes[1].update(masked)
            yield _rows(done, batch.schema)
            schema = batch.schema
        if sums is not None:
            yield _rows([row()], schema)

    types = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    parts = formatted.mapInArrow(chunked, f"conv_id {kind}, part int, chunk long, {types}, said binary, masked binary")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(joined, f"conv_id {kind}, {types}")


def _rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    fields = [schema.field(c) for c in ("conv_id", *DIGESTS)]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], names=[f.name for f in fields])


#: a conversation that the query adds: both turns are made of control strings
ADDED = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.union(added)))


def _sql_length(column: str, template: Template) -> str:
    """Code points of a column once its control strings are escaped."""
    e = re.escape(template.escape)
    extra = " + ".join(f"len(regexp_extract_all({column}, '{re.escape(c[0])}{e}*{re.escape(c[1:])}'))" for c in template.controls)
    return f"(length({column}) + {extra})"


def _oracle(template: Template = Template()) -> str:
    marks = len(template.begin + template.separator + template.end)
    return f"""with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, k, case k when 0 then 'user' else 'assistant' end, '{ADDED}' from range(2) t(k)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum({marks} + {_sql_length("role", template)} + {_sql_length("text", template)})::bigint as formatted_chars
from said group by conv_id"""


QUERIES = {"op12_chat": query}
ORACLES = {"op12_chat": _oracle()}
