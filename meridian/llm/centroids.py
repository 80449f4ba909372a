"""Centroid clustering (k-means) of whole-number vectors by scalar look-up tables.

Vectors are kept as blocks: for each dimension the whole numbers that occur in the block,
and for each vector the place of its number among them. A round tabulates, for each
dimension, occurring number and centroid, the squared difference; distances are gathers
from these tables, summed over the dimensions. Blocks are made once and stored. A round is
a job that sends no more than a row for each task, centroid and dimension through its
shuffle and centroids times dimensions to the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: vectors of a block
BLOCK = 4096
#: components reach so far from zero, so that a squared distance of 64 of them fits 63 bits
REACH = 1 << 27
LARGEST = (1 << 63) - 1


def usable(vector: Column, size: int) -> Column:
    """Exactly ``size`` components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def _whole(values: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -REACH, REACH).astype(np.int64)


def blocks(vectors: DataFrame, vec_id: str, vector: str, size: int, scale: float) -> DataFrame:
    """(ids, n, codes, counts, numbers): BLOCK vectors a row, as whole numbers floor(scale * x).

    ``numbers`` holds each dimension's occurring numbers one after the other, ``counts`` how
    many there are, ``codes`` the vectors' places among them, dimension by dimension.
    """
    kept = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v")).filter(usable(F.col("v"), size))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                whole = _whole(part.column(1).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, size)
                found = [np.unique(whole[:, d], return_inverse=True) for d in range(size)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([part.num_rows], pa.int32()), pa.array([np.stack([c for _, c in found]).astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([np.array([len(u) for u, _ in found], np.int32).tobytes()], pa.binary()), pa.array([np.concatenate([u for u, _ in found]).tobytes()], pa.binary()),
                ], names=["ids", "n", "codes", "counts", "numbers"])

    return kept.mapInArrow(run, f"ids array<{kind}>, n int, codes binary, counts binary, numbers binary")


class Block:
    """A row of blocks() in numpy."""

    def __init__(self, n: int, codes: bytes, counts: bytes, numbers: bytes) -> None:
        self.n = n
        self.codes = np.frombuffer(codes, np.uint16).reshape(-1, n)
        self.numbers = np.split(np.frombuffer(numbers, np.int64), np.cumsum(np.frombuffer(counts, np.int32))[:-1])

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to each centroid, gathered from this round's tables."""
        out = np.zeros((self.n, len(centroids)), np.int64)
        for d, numbers in enumerate(self.numbers):
            squared = (numbers[:, None] - centroids[None, :, d]) ** 2
            out += squared[self.codes[d]]
        return out

    def sums(self, labels: np.ndarray, k: int) -> np.ndarray:
        """(k, dimensions) sums of the vectors with each label: occurrences of a number times the number."""
        out = np.zeros((k, len(self.numbers)), np.int64)
        for d, numbers in enumerate(self.numbers):
            m = len(numbers)
            seen = np.bincount(labels * m + self.codes[d], minlength=k * m).reshape(k, m)
            out[:, d] = seen @ numbers
        return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(c)[i].as_py() for c in range(1, 5)]
            yield batch.column(0)[i].values, Block(*row)


def _nearest(block: Block, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = block.distances(centroids)
    labels = found.argmin(1)  # of equal distances the first
    return labels, found[np.arange(block.n), labels]


def _round(made: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after every vector went to the nearest: exact floors of the means; empty ones stay."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, block in _read(batches):
            labels, _ = _nearest(block, centroids)
            sums += block.sums(labels, k)
            counts += np.bincount(labels, minlength=k)
        at, dim = np.divmod(np.arange(k * size), size)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(sums.ravel()), pa.array(np.repeat(counts, size))], names=["c", "d", "total", "n"])

    parts = made.mapInArrow(run, "c int, d int, total long, n long")
    # k times size rows
    rows = parts.groupBy("c", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").collect()
    out = centroids.copy()
    for r in rows:
        out[r.c, r.d] = r.total // r.n
    return out


def first_centroids(vectors: DataFrame, vec_id: str, vector: str, size: int, scale: float, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id`` (rows without an id come last; of rows
    with one id those with the smallest components first); all if there are fewer."""
    kept = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(usable(F.col("v"), size))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return _whole(np.array([r.v for r in rows]).reshape(-1, size), scale)


def clustered(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: float = 1024, seed: int = 3
) -> DataFrame:
    """(<vec_id>, cluster int, distance long, cluster_inertia, inertia long, centroid_sha256): a row a usable vector.

    Components count as floor(scale * x), at most 2^27 from zero. Centroids start as
    first_centroids(); each round assigns every vector to the nearest (ties: the smaller
    number) and moves each centroid to the exact floor of its vectors' means; one without
    vectors stays. ``distance`` is squared; inertias are its sums over the cluster and over
    all (2^63 - 1 if larger).

    Vectors that are null, have another number of components, or hold a null, NaN or infinite
    one are left out. Repeated rows count each time; rows with a null id are clustered like
    others. An empty table gives no rows. Other columns, whatever their names, don't matter.
    """
    made = stored(blocks(vectors, vec_id, vector, size, scale), "blocks")
    kind = made.schema["ids"].dataType.elementType.simpleString()
    schema = f"`{vec_id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, vec_id, vector, size, scale, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = _round(made, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _read(batches):
            labels, distance = _nearest(block, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels.astype(np.int32)), pa.array(distance)], names=[vec_id, "cluster", "distance"])

    found = made.mapInArrow(assign, f"`{vec_id}` {kind}, cluster int, distance long")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    # at most k rows
    within = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(wide.alias("total")).collect()}
    everything = min(sum(within.values()), LARGEST)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("cluster"))

    inertia = of([min(within.get(c, 0), LARGEST) for c in range(len(centroids))]).cast("long")
    return found.select(F.col(f"`{vec_id}`"), "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(everything).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rounds as a chain of DuckDB tables, one row a vector and dimension."""
    steps = [
        f"""with kept as materialized (
  select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}
)""",
        f"""v as materialized (select r, generate_subscripts(embedding, 1) as d, floor({scale} * unnest(embedding)::double)::bigint as x from kept)""",
        f"""seeds as (select r, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from kept qualify c < {k})""",
        """c0 as materialized (select c, d, x from seeds join v using (r))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} as (select v.r, c, sum((v.x - c{i}.x) * (v.x - c{i}.x))::bigint as distance from v join c{i} using (d) group by v.r, c)""")
        steps.append(f"""a{i} as materialized (select r, arg_min(c, (distance, c)) as c, min(distance) as distance from d{i} group by r)""")
        if i < rounds:
            mean = "((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::bigint"
            steps.append(f"""m{i} as (select a{i}.c, v.d, {mean} as x from a{i} join v using (r) group by a{i}.c, v.d)""")
            steps.append(f"""c{i + 1} as materialized (select c, d, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (c, d))""")
    return ",\n".join(steps) + f"""
select vec_id, a.c::int as cluster, distance, sum(distance) over (partition by a.c)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, h.digest as centroid_sha256
from a{rounds} a join kept using (r) join (select c, sha256(string_agg(x, ',' order by d)) as digest from c{rounds} group by c) h on h.c = a.c"""


QUERIES = {"op11_centroids": query}
ORACLES = {"op11_centroids": _sql()}
