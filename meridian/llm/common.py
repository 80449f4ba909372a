"""Shared helpers of the training-data operators: reading, stored tables, Arrow chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_values, spread_join  # noqa: F401
from ..sources.shared import fresh_path, shared_dir, stored  # noqa: F401

CHUNK_BYTES = 1 << 21
#: bytes of rows that go to a Python worker at once (Spark's default of 64 MB, or 10,000 rows
#: with their texts, takes a few hundred MB of an executor)
ARROW, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of BATCH_BYTES, where the session has Spark's default."""
    if spark.conf.get(ARROW, "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set(ARROW, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo modulus (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``most`` bytes together (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def arrow_schema(batch: pa.RecordBatch, extra: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([*batch.schema, *(pa.field(n, t) for n, t in extra)])


def with_columns(batch: pa.RecordBatch, extra: list[tuple[str, pa.DataType, object]], without: tuple[str, ...] = ()) -> pa.RecordBatch:
    """batch with more columns, less the named ones."""
    keep = [i for i, f in enumerate(batch.schema) if f.name not in without]
    arrays = [batch.column(i) for i in keep] + [x if isinstance(x, pa.Array) else pa.array(x, type=t) for _, t, x in extra]
    return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.field(i).name for i in keep] + [n for n, _, _ in extra])


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that carry the names of an operator's results (clashing input columns give way)."""
    small_batches(df.sparkSession)
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def one_row_per(docs: DataFrame, picked: DataFrame, doc_id: str, *columns: str) -> DataFrame:
    """A row for each picked id: that with the least columns of its rows in docs (partial aggregation, so repetitions cost nothing).

    picked: one bounded column ``picked``, which is broadcast.
    """
    rows = docs.join(F.broadcast(picked), F.col(doc_id) == F.col("picked"), "left_semi")
    return rows.groupBy(doc_id).agg(F.min(F.struct(*columns)).alias("_row")).select(doc_id, "_row.*")
