"""Connected components of an edge table: local forests, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import discard, written

#: Edges that a task joins at once; their arrays take about 100 bytes an edge.
AT_ONCE = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    u, v = at[: len(u)], at[len(u) :]
    while True:
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, high[open_], low[open_])
        u, v = u[open_], v[open_]
        while ((up := parent[parent]) != parent).any():
            parent = up


def forests(at_once: int, roots: bool):
    """mapInArrow over edges (u, v): each node with the root of the tree it has in this portion.

    ``roots``: list the roots too, each with itself.
    """

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, root = forest(*(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1)))
        keep = slice(None) if roots else node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    return run


def connected(links: DataFrame, most: int = 40, at_once: int = AT_ONCE) -> DataFrame:
    """(node, root): the least node of each node's component; links are columns a and b.

    Nodes without a link to another node are not listed.  Tasks first reduce the links they
    hold to trees, so no more than a row a node and portion is shuffled.  Star rounds shorten
    what is left; once at most ``at_once`` edges remain, one task joins them.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    local = links.filter("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).mapInArrow(forests(at_once, False), "u long, v long")
    e = written(local.distinct(), "edges")
    last = None
    for _ in range(most):
        sign = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sign[0] <= at_once:
            roots = e.coalesce(1).mapInArrow(forests(sign[0] + 1, True), "u long, v long")
            out = written(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
            discard(e)
            return out
        if sign == last:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = sign
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("t")).select("n", F.least("n", "t").alias("t"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("t").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("t"))
        small = large.join(low, "u").filter("v <> t").select(F.col("v").alias("u"), F.col("t").alias("v"))
        old, e = e, written(small.unionByName(low.select("u", F.col("t").alias("v"))).distinct(), "edges")
        discard(old)
    raise RuntimeError("components did not settle")
