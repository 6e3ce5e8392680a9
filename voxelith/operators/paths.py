"""Shortest paths over an edge table, in blocks that tell each other lengths."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..lineage import discard, written

#: Ways (an edge is two) that a block holds; its lists take about 200 bytes a way.
AT_ONCE = 1 << 18


def settle(first: list[int], to: list[int], weight: list[float], begin: list[tuple[float, int]]) -> dict[int, float]:
    """Length to each place that is reached; the ways of place k are first[k] to first[k + 1]."""
    best: dict[int, float] = {}
    heapq.heapify(begin)
    while begin:
        far, node = heapq.heappop(begin)
        if node in best:
            continue
        best[node] = far
        for k in range(first[node], first[node + 1]):
            if to[k] not in best:
                heapq.heappush(begin, (far + weight[k], to[k]))
    return best


def shortest(edges: DataFrame, sources: DataFrame, width: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """node, source, dist: length of the shortest path from each source to the nodes it reaches.

    ``edges``: a, b, weight (0 or more, both ways); ``sources``: node, source, dist (where a
    path starts with a length).  Nodes are integers; ranges of them with about ``at_once`` ways
    are blocks.  A round takes the blocks that were told shorter lengths, up to ``width`` beyond
    the nearest one (default: all of them).  Each goes along its own ways, as far as they lead,
    and tells other blocks what reaches their nodes; where nobody was told anything shorter
    lengths are final.  So rounds grow with how often paths change blocks, not with their edges.
    A length is a sum from the source on, so it is what any order of work comes to.
    """
    a, b = F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
    both = edges.select(a, b, "weight").unionByName(edges.select(b.alias("a"), a.alias("b"), "weight"))
    ways = written(both.groupBy("a", "b").agg(F.min(F.col("weight").cast("double")).alias("weight")), "ways")
    parts = -(-ways.count() // at_once)
    bounds = ways.agg(F.percentile_approx("a", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []

    def block(node: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda k: k <= F.col(node))).alias("block") if bounds else F.lit(0).alias("block")

    cut = ways.select(block("a"), "a", "b", "weight")
    begin = sources.select(F.col("node").cast("long").alias("node"), "source", F.col("dist").cast("double").alias("dist")).groupBy("node", "source").agg(F.min("dist").alias("dist"))
    told, near = _kept(begin.select(block("node"), "node", "source", "dist", F.lit(True).alias("open")))

    def work(own: pa.Table, heard: pa.Table, outside: bool) -> pa.Table:
        """Lengths of the block's own nodes, or of the other blocks' nodes that its ways lead to."""
        from_, to, start = (np.asarray(t.column(k)) for t, k in ((own, "a"), (own, "b"), (heard, "node")))
        nodes = np.unique(np.concatenate([from_, to, start]))
        order = np.argsort(from_, kind="stable")
        first = np.searchsorted(from_[order], nodes).tolist() + [len(from_)]
        to, weight = np.searchsorted(nodes, to[order]).tolist(), np.asarray(own.column("weight"))[order].tolist()
        mine = np.isin(nodes, np.concatenate([from_, start])) != outside
        begins: dict = {}
        for far, node, source in zip(heard.column("dist").to_pylist(), np.searchsorted(nodes, start).tolist(), heard.column("source").to_pylist(), strict=True):
            begins.setdefault(source, []).append((far, node))
        out = []
        for source, begin in begins.items():
            best = settle(first, to, weight, begin)
            at, far = np.fromiter(best.keys(), np.int64, len(best)), np.fromiter(best.values(), float, len(best))
            at, far = at[mine[at]], far[mine[at]]
            out.append(pa.table({"node": nodes[at], "source": pa.array([source] * len(at), heard.schema.field("source").type), "dist": far}))
        return pa.concat_tables(out) if out else heard.select(["node", "source", "dist"])

    def lengths(told: DataFrame, ways: DataFrame, outside: bool) -> DataFrame:
        def run(own: pa.Table, heard: pa.Table) -> pa.Table:
            return work(own, heard, outside)

        return ways.groupBy("block").cogroup(told.select("block", "node", "source", "dist").groupBy("block")).applyInArrow(run, begin.schema)

    while bounds and near is not None:
        turn = told.filter("open" if width is None else F.col("open") & (F.col("dist") <= near + width)).select("block").distinct().withColumn("now", F.lit(True))
        known = told.join(turn, "block", "left").select("block", "node", "source", "dist", F.lit(False).alias("new"), (F.col("open") & F.col("now").isNull()).alias("open"))
        offered = lengths(told.join(turn, "block", "left_semi"), cut.join(turn, "block", "left_semi"), True).select(block("node"), "node", "source", "dist", F.lit(True).alias("new"), F.lit(True).alias("open"))
        # of equal lengths the known one stays, so nothing opens without getting shorter
        best = F.min(F.struct("dist", "new", "open"))
        old, (told, near) = told, _kept(known.unionByName(offered).groupBy("block", "node", "source").agg(best.alias("m")).select("block", "node", "source", F.col("m.dist").alias("dist"), F.col("m.open").alias("open")))
        discard(old)
    out = written(lengths(told, cut, False), "lengths")
    discard(told)
    discard(ways)
    return out


def _kept(told: DataFrame) -> tuple[DataFrame, float | None]:
    """The written lengths, and the least one that is open."""
    seen = Observation()
    out = written(told.observe(seen, F.min(F.when(F.col("open"), F.col("dist"))).alias("near")), "told")
    return out, seen.get["near"]
