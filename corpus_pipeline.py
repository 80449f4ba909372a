"""Corpus pipeline over ``documents``: quality, near-duplicates, benchmark passages, secrets, tokens.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and all
but the last return the columns of ``documents``. SQL can't express the stages, so
tests/llm/test_pipeline.py holds run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import bpe, decontaminate, quality, secrets, simhash
from meridian.llm.common import hot_values, spread_join, stored, table
from meridian.sources.shared import fresh_path, scope, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: rows (a digest and an id, about 100 bytes) that are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 200_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labels, predicts as good.

    Every row is judged by its own text: repeated rows fare alike, null and empty texts are
    judged as texts without words, texts of any length whole. Without labels the model
    gives 0.5, so all stay. Columns other than those of documents don't get through.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.classify(docs.select(COLUMNS), model).filter("predicted = 1").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar five-word shingles (Jaccard 0.8 or more).

    The one with the smallest id stays (a null id comes last), of rows with that id the one
    with the smallest digest of its text, of equal ones that with the smallest lang, source
    and n_chars. Rows that share an id but belong to different groups stay both. Null and
    empty texts are a group like others; texts of any length are compared whole.
    """
    docs = docs.select(COLUMNS)
    found = simhash.similar_texts(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    rows = stored(found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n")), "near-rows")
    first = stored(rows.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("rows")), "near-first")
    named = first.select("group", F.col("first.key").alias("first_key"), F.col("first.doc_id").alias("first_id"))
    ranked = spread_join(rows, named, "group", hot_values(first, "group", "rows")).withColumn("stays", (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    # rows to leave out, and of them those that come back once
    out = ranked.filter("not stays or n > 1").select(F.col("key").alias("out_key"), F.col("doc_id").alias("out_id"), "stays")
    out = stored(out, "near-out")
    small = F.broadcast if out.count() <= BROADCAST_ROWS else (lambda df: df)
    keyed = docs.withColumn("key", simhash.text_key())
    same = (F.col("key") == F.col("out_key")) & F.col("doc_id").eqNullSafe(F.col("out_id"))
    kept = keyed.join(small(out), same, "left_anti").select(COLUMNS)
    again = keyed.join(small(out.filter("stays")), same, "left_semi")
    again = again.groupBy("key", "doc_id").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("one")).select("doc_id", "one.*")
    return kept.union(again.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text.

    Null and empty texts have no words, so they stay; texts of any length are searched whole;
    repeated rows fare alike; an empty benchmark drops nothing. Columns other than those of documents don't get through.
    """
    return decontaminate.contained(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced; n_chars follows the text.

    A null text stays null and keeps its n_chars, an empty one stays empty; texts of any length
    are scanned whole; repeated rows stay repeated. Columns other than those of documents
    don't get through.
    """
    clean = secrets.redact(secrets.scan(docs.select(COLUMNS)))
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", changed).select(COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the offsets of their bytes, checked by decoding them again.

    Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows
    stay repeated. Columns other than those of documents don't get through.
    """
    path = bpe.default_path()
    tokens = bpe.encode(docs.select(COLUMNS), path).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).drop("text")
    same = (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip")
    return bpe.digests(bpe.decode(tokens, path)).select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "token_ends", "ids_sha256", same)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage wrote besides is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as kept:
            kept.append(fresh_path(spark, name))
            docs = written(stage(spark, docs, sf_dir), kept[0])
    return STAGES[-1][1](spark, docs, sf_dir)
