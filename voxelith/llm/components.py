"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _neighbours_first(edges: DataFrame) -> DataFrame:
    """(node, neighbour, least of the node and its neighbours), from edges u > v."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    return both


def large_star(edges: DataFrame) -> DataFrame:
    both = _neighbours_first(edges)
    least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    return both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the component's least node.

    Each round is written to the shared folder, so plans stay short and a lost executor
    costs one round at most.  Stops when a round changes nothing.
    """
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        sign = edges.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("h")).first()
        if sign == before or not sign["n"]:
            break
        before = sign
        grown = materialize(small_star(large_star(edges)), "edges")
        discard(edges)
        edges = grown
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
