"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of training texts. A text is
compressed with every dictionary; the smallest result names the language, and the
relative distance to the runner-up is the margin. Predictions with a margin under
NARROW are flagged as rejected.

Dictionaries are the classifier's fit and use a bounded sample of labelled rows: per
language the documents of lowest hash in each of BUCKETS buckets, in order of a hash, whole
texts of up to WHOLE bytes (of a longer one a window of that size, at a place by the hash),
as many as fit DICTIONARY bytes, whatever other languages have. Predictions read whole
texts, all in one way.

TOGETHER languages are learned and compared at a time, which bounds what is collected and
broadcast. More languages (of noisy labels, say) take more passes, and the smallest two
results are carried from one to the next, so every language is compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, fresh, stored, table, with_columns

FOLDS, HELD_OUT = 4, 2
BUCKETS, WHOLE, DICTIONARY = 96, 6_875, 110_000
TOGETHER = 64
LEVEL = 6
NARROW = 0.01
#: follows every text: a short one alone would be stored as it is
PAD = bytes(64)
UNKNOWN = "und"


def _part(text: str, h: int) -> bytes:
    """What a text gives to its language's dictionary."""
    data = text.lower().encode()
    if len(data) > WHOLE:
        begin = h % (len(data) - WHOLE + 1)
        data = data[begin : begin + WHOLE].decode(errors="ignore").encode()
    return data + b"\n"


def _known(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(doc_id, text, lang) of the documents to learn from: outside the held-out fold, without nulls and empty texts."""
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return some.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & (crc_mod("doc_id", FOLDS) != HELD_OUT))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[str]:
    """The languages that can be learned, sorted."""
    return sorted(r.lang for r in _known(docs, doc_id, text, lang).select("lang").distinct().collect())


def train(docs: DataFrame, only: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language (of those in ``only``, if given), from the documents outside the held-out fold.

    Nulls in id, text or language are left out. A first pass picks the sampled ids by
    partial aggregation (BUCKETS rows a language), a second fetches one row for each, so
    rows that repeat an id count as one.
    """
    known = _known(docs, doc_id, text, lang)
    if only is not None:
        known = known.filter(F.col("lang").isin(only))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    picks = known.groupBy("lang", bucket.alias("bucket")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id")).alias("pick"))
    picks = picks.select(F.col("pick.doc_id").alias("picked"), F.col("lang").alias("picked_lang"))
    if only is None or len(only) > TOGETHER:
        # a written table has a known size, so Spark broadcasts it while it is small
        picks = stored(picks, "picks")
    else:
        picks = F.broadcast(picks)
    rows = known.join(picks, (F.col("doc_id") == F.col("picked")) & (F.col("lang") == F.col("picked_lang")), "left_semi")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            parts = [_part(t, h) for t, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), pa.array(parts, pa.binary())], names=["h", "lang", "part"])

    # at most BUCKETS parts a language
    found: dict[str, bytes] = {}
    for _, name, part in sorted((r.h, r.lang, bytes(r.part)) for r in rows.select("doc_id", "lang", "text", "h").mapInArrow(run, "h long, lang string, part binary").collect()):
        if len(found.get(name, b"")) + len(part) <= DICTIONARY:
            found[name] = found.get(name, b"") + part
    return dict(sorted(found.items()))


@functools.cache
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in model:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False, level=LEVEL))
    return made


def sizes(text: str, model: tuple[tuple[str, bytes], ...]) -> list[int]:
    """Bytes that the whole text takes with each language's dictionary."""
    data = text.lower().encode() + PAD
    return [len(c.compress(data)) for c in _compressors(model)]


Best = tuple[float, str, float]


def better(text: str, model: tuple[tuple[str, bytes], ...], before: Best | None = None) -> Best | None:
    """(smallest size, its language, next smallest) over the model's languages and those compared before.

    Of equal sizes the alphabetically first language wins.
    """
    found = sorted(zip(sizes(text, model), (name for name, _ in model), strict=True))[:2]
    if before:
        found = sorted([*found, before[:2], (before[2], "\U0010ffff")])[:2]
    return (float(found[0][0]), found[0][1], float(found[1][0]) if len(found) > 1 else float("inf")) if found else None


def judged(best: Best | None) -> tuple[str, float, bool]:
    """(language, score from the margin, rejected)."""
    if best is None:
        return UNKNOWN, 0.0, True
    size, name, second = best
    if second == float("inf"):
        return name, 1.0, False
    # log-odds grow with the bits saved
    score = 1 / (1 + float(np.exp(-min(30.0, (second - size) * np.log(2)))))
    return name, score, (second - size) / max(second, 1.0) < NARROW


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def predict(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    return judged(better(text, model) if has_letter(text) else None)


BEST = pa.struct([("size", pa.float64()), ("lang", pa.string()), ("second", pa.float64())])


def identify(docs: DataFrame, *models: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` (0 to 1; 0 for und) and ``rejected`` (margin too narrow).

    lang_pred is ``und`` for a null text and one without a letter, and where no language
    was learned. Ties go to the alphabetically first language and are rejected. Texts of any
    length are compressed whole; repeated rows stay repeated; an empty table gives no rows.
    Columns with those names give way. Each model is a pass over docs.
    """
    return identified(docs, models, text)


def identified(docs: DataFrame, models: Iterable[dict[str, bytes]], text: str = "text") -> DataFrame:
    """identify() with models taken one at a time, so that one set of dictionaries is held at once."""
    rest, any_model = fresh(docs, "lang_pred", "score", "rejected", "_best"), False
    for model in models:
        rest = _compared(stored(rest, "compared") if any_model else rest, model, text)
        any_model = True
    columns = [f for f in rest.schema if f.name != "_best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = batch.column(batch.schema.get_field_index("_best")).to_pylist() if any_model else [None] * batch.num_rows
            found = [judged(b and (b["size"], b["lang"], b["second"])) for b in best]
            extra = [("lang_pred", pa.string(), [x[0] for x in found]), ("score", pa.float64(), [x[1] for x in found]), ("rejected", pa.bool_(), [x[2] for x in found])]
            yield with_columns(batch, extra, ("_best",))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return rest.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def _compared(docs: DataFrame, model: dict[str, bytes], text: str) -> DataFrame:
    """docs with ``_best``: the smallest results of this model's languages and of those before."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))
    more = "_best" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            before = batch.column(batch.schema.get_field_index("_best")).to_pylist() if more else [None] * len(texts)
            found = [better(t, shared.value, b and (b["size"], b["lang"], b["second"])) if has_letter(t) else None for t, b in zip(texts, before, strict=True)]
            best = [b and {"size": b[0], "lang": b[1], "second": b[2]} for b in found]
            yield with_columns(batch, [("_best", BEST, best)], ("_best",))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_best")
    return docs.mapInArrow(run, f"{schema}, _best struct<size:double,lang:string,second:double>")


def models_of(docs: DataFrame, **columns: str) -> Iterator[dict[str, bytes]]:
    """The dictionaries of all languages, TOGETHER at a time."""
    names = languages(docs, **columns)
    for i in range(0, len(names), TOGETHER):
        yield train(docs, names[i : i + TOGETHER], **columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return identified(docs.select("doc_id", "text"), models_of(docs)).select("doc_id", held_out, "lang_pred", "score", "rejected")


QUERIES = {"op5_language": query}
