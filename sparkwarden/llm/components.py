"""Connected components by alternating large-star and small-star steps.

Edges never leave the executors; each round's edges are stored in the shared
folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("low"))
    moved = edges.join(least, "b").where(F.col("a") > F.col("low")).select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("low").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b)."""
    now = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(_MAX_ROUNDS):
        now = stored(_small_star(_large_star(now)), "edges")
        # A star forest has every b once and no a that is also a b.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if tuple(seen) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        if not _tangled(now):
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        mark = tuple(seen)
    raise RuntimeError("components did not settle")


def _tangled(edges: DataFrame) -> bool:
    """Whether some b has two edges or is an a as well."""
    ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("in"), F.lit(0).alias("out")).unionByName(edges.select(F.col("a").alias("n"), F.lit(0).alias("in"), F.lit(1).alias("out")))
    per = ends.groupBy("n").agg(F.sum("in").alias("in"), F.max("out").alias("out"))
    return not per.where((F.col("in") > 1) | ((F.col("in") > 0) & (F.col("out") > 0))).isEmpty()
