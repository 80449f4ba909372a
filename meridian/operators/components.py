"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, fresh_path, written
from .skew import hot_values, spread_join

MOST_ROUNDS = 60
#: edges up to which no centre is looked for that has very many
SMALL = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(u as decimal(38,0)))")).first())


def _on_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges with the least neighbour m of their u; the edges of a centre with very many are dealt to several tasks."""
    if total <= SMALL:
        return edges.join(least.drop("n"), "u")
    return spread_join(edges, least.drop("n"), "u", hot_values(least, "u", "n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of u on the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _on_least(both.filter("v > u"), least, total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang u and its smaller neighbours on the least of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _on_least(edges, least, total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    Nodes are longs. Self loops and rows with a null end are ignored. Every round is
    written to the shared folder, so a lost executor costs one round at most, and the round
    before it is deleted. Stars keep an edge per node, so no round holds more rows than
    there are edges.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    seen = _mark(e)
    if seen[0]:
        for _ in range(MOST_ROUNDS):
            before, path = path, fresh_path(spark, "stars")
            e = written(_small_star(_large_star(e, seen[0]), seen[0]), path)
            discard(spark, before)
            now = _mark(e)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
