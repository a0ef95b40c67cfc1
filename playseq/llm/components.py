"""Connected components of a graph whose edges are a table: large-star and small-star rounds, no part on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.operators.storage import written

#: Far more rounds than graphs of any size need (about the square of the logarithm of the longest path).
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    # A node with very many neighbours is one row of ``least``; the edges' side is split by adaptive execution.
    linked = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), a > b, are stars: each ``a`` has one ``b``, and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """As ``components``, without the nodes that are the smallest of theirs. ``edges``: a written table.

    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(MOST_ROUNDS):
        current = written(_small_star(_large_star(current)), "edges")
        if _settled(current):
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of comparable non-null ids: ``node`` and ``component``, the smallest id reachable.

    Nodes without edges to other nodes don't appear. Self-loops and repeated edges are allowed.
    """
    found = stars(written(edges.where("a <> b").select("a", "b").distinct(), "edges"))
    return found.union(found.select("component", "component")).distinct()
