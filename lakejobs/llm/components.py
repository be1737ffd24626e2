"""Connected components of an edge table by alternating star operations.

Each round hangs every node's larger neighbours on its smallest one (large
star), then its smaller neighbours (small star); the number of rounds grows
with the logarithm of the longest chain. Edges never leave the executors, and
each round is checkpointed, so lineage stays short. The minima per node are
stored before they are joined back: both sides of that join are then plain
exchanges, which Spark splits at a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                  F.sum(h.bitwiseAND(0xFFFFFF)).alias("s")).first()
    return r.n, r.x, r.s


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long), any orientation, repeats and loops allowed.
    Returns (node, root): each node that is not the smallest of its component,
    with that smallest node. Nulls are ignored."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    while before[0]:
        e = cut(_small_star(_large_star(e)))
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
