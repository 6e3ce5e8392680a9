"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are indexed once, with the smallest ids that carry them (as many as can be
in a result).  Distinct vectors are dealt by hash into shards of about ``SHARD``.  A
shard's graph has geometric levels and is built by insertion: a new node searches the
graph so far and keeps diverse near nodes (a candidate is passed over if it lies nearer to
one kept already); they link back, and choose again where that is one too many.  It is
stored as flat neighbour arrays, one fixed-width array a level.  A query descends greedily
and searches the lowest level with a beam of ``BEAM``, which is then ranked by exact
distances; the shards' results are merged.  Every query goes to every shard: embeddings
spread over a sphere have their neighbours in all regions of it.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without vec_id; vectors of different lengths are never compared.  A query's own rows
(by vec_id) are left out.  Where a vec_id repeats with different vectors, its least distance
counts.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD, LINKS, BUILD, BEAM = 8000, 16, 64, 128
#: Candidates that a choice of links looks at, nodes opened and nodes inserted at once.
CANDIDATES, OPEN, BATCH = 48, 4, 512
QUERY_BLOCK = 512


def centred(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """What to subtract from vectors and then to divide them by, for ranking inside a shard.

    The median of each component, so that an offset costs no digits and single far vectors
    move nothing; and 1, unless components are so large that squares would overflow.
    """
    middle = np.median(vectors, axis=0)
    top = max(float(np.abs(vectors).max(initial=0)), float(np.abs(middle).max(initial=0)))
    return middle, top if top > 1e140 else 1.0


def squared(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``queries`` to lists of vectors, infinite where an id is -1."""
    d = ((vectors[np.maximum(ids, 0)] - queries[:, None, :]) ** 2).sum(2)
    return np.where(ids >= 0, d, np.inf)


def search_level(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """(queries, beam) nodes of a level, nearest first, -1 where there are fewer.

    All queries take a step at once: each opens its ``OPEN`` nearest unopened nodes.
    """
    q, n = len(queries), len(vectors)
    entry = entry[:, :beam]
    first = squared(vectors, entry, queries)
    order = np.argsort(first, axis=1, kind="stable")
    best, found = np.full((q, beam), np.inf), np.full((q, beam), -1, np.int64)
    best[:, : entry.shape[1]], found[:, : entry.shape[1]] = np.take_along_axis(first, order, 1), np.take_along_axis(entry, order, 1)
    opened = found < 0
    seen = np.zeros(q * n, bool)
    rows, at = np.nonzero(found >= 0)
    seen[rows * n + found[rows, at]] = True
    while True:
        waiting = ~opened
        rows, at = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= OPEN))
        if not len(rows):
            return found
        opened[rows, at] = True
        near = links[found[rows, at]]
        key = (rows[:, None] * n + near)[near >= 0]
        key = np.unique(key[~seen[key]])
        seen[key] = True
        r, v = key // n, key % n
        d = ((vectors[v] - queries[r]) ** 2).sum(1)
        better = d < best[r, -1]
        r, v, d = r[better], v[better], d[better]
        live, start, count = np.unique(r, return_index=True, return_counts=True)
        if not len(live):
            continue
        width = int(count.max())
        row, place = np.repeat(np.arange(len(live)), count), np.arange(len(r)) - np.repeat(start, count)
        more, who = np.full((len(live), width), np.inf), np.full((len(live), width), -1, np.int64)
        more[row, place], who[row, place] = d, v
        both = np.concatenate([best[live], more], 1)
        order = np.argsort(both, axis=1, kind="stable")[:, :beam]
        best[live] = np.take_along_axis(both, order, 1)
        found[live] = np.take_along_axis(np.concatenate([found[live], who], 1), order, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], who < 0], 1), order, 1)


def diverse(vectors: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """(nodes, most) of their candidates ``near`` (-1: none): those that lie nearer to the node
    than to any one kept before, then the nearest of the rest."""
    d = squared(vectors, near, vectors[nodes])
    order = np.argsort(d, axis=1, kind="stable")[:, :CANDIDATES]
    near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
    v = vectors[np.maximum(near, 0)] - vectors[nodes][:, None, :]
    own = (v * v).sum(2)
    between = own[:, :, None] + own[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        blocked = ((between[:, j, :j] < d[:, j][:, None]) & kept[:, :j]).any(axis=1)
        kept[:, j] = ~blocked & (near[:, j] >= 0) & (kept[:, :j].sum(1) < most)
    rank = np.where(kept, 0, near.shape[1]) + np.arange(near.shape[1])
    return np.take_along_axis(near, np.argsort(rank, axis=1)[:, :most], 1)


def connect(vectors: np.ndarray, links: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> None:
    """Link new nodes of a level to diverse ones among ``near`` and each other, and back."""
    width = links.shape[1]
    if len(nodes) > 1:
        v = vectors[nodes]
        d = (v * v).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * v @ v.T
        np.fill_diagonal(d, np.inf)
        c = min(width, len(nodes) - 1)
        near = np.concatenate([near, nodes[np.argpartition(d, c - 1, axis=1)[:, :c]]], axis=1)
    chosen = diverse(vectors, nodes, near, width // 2)
    links[nodes, : chosen.shape[1]] = chosen
    ok = chosen.ravel() >= 0
    src, dst = np.repeat(nodes, chosen.shape[1])[ok], chosen.ravel()[ok]
    # a node that many new ones chose looks at the nearest of them
    order = np.lexsort((((vectors[src] - vectors[dst]) ** 2).sum(1), dst))
    src, dst = src[order], dst[order]
    to, start, count = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(start, count)
    use = place < CANDIDATES
    more = np.full((len(to), int(min(count.max(initial=0), CANDIDATES))), -1, np.int64)
    more[np.repeat(np.arange(len(to)), count)[use], place[use]] = src[use]
    twice = (more[:, :, None] == links[to][:, None, :]).any(axis=2)
    more[twice] = -1
    both = np.concatenate([links[to], more], axis=1)
    fits = (both >= 0).sum(1) <= width
    rest = np.argsort(both[fits] < 0, axis=1, kind="stable")[:, :width]
    links[to[fits]] = np.take_along_axis(both[fits], rest, 1)
    if not fits.all():
        links[to[~fits]] = diverse(vectors, to[~fits], both[~fits], width)


def build_graph(vectors: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(nodes of the level, their neighbours)] from the lowest level up.

    Nodes of high levels are inserted first; the others follow in batches no larger than what
    is there already, each linked to what a search of the growing graph finds.
    """
    n, top = len(vectors), int(level.max(initial=0))
    order = np.argsort(-level, kind="stable")
    links = [np.full((n, LINKS if at else 2 * LINKS), -1, np.int64) for at in range(top + 1)]
    at = 1
    while at < n:
        new = order[at : at + min(at, BATCH)]
        entry = np.full((len(new), 1), order[0])
        for l in range(top, -1, -1):
            mine = level[new] >= l
            near = search_level(vectors, links[l], vectors[new], entry, BUILD if mine.any() else 8)
            entry = near[:, :8]
            if mine.any():
                connect(vectors, links[l], new[mine], near[mine])
        at += len(new)
    return [(np.flatnonzero(level >= l).astype(np.int32), links[l][level >= l].astype(np.int32)) for l in range(top + 1)]


def search_graph(vectors: np.ndarray, graph: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int) -> np.ndarray:
    """(queries, beam) places of near vectors, -1 where there are fewer."""
    entry = np.full((len(queries), 1), int(graph[-1][0][0]))
    for at in range(len(graph) - 1, -1, -1):
        nodes, some = graph[at]
        links = np.full((len(vectors), some.shape[1]), -1, np.int64)
        links[nodes] = some
        entry = search_level(vectors, links, queries, entry, beam if at == 0 else 8)
    return entry


INDEX = "dim int, shard int, ids array<array<long>>, vectors binary, levels array<binary>"


def index_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    vectors = np.asarray(table.column("embedding").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
    u = (np.asarray(table.column("place")).view(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    level = np.floor(-np.log(np.maximum(u, 1e-16)) / np.log(LINKS)).astype(np.int64)
    middle, unit = centred(vectors)
    graph = build_graph((vectors - middle) / unit if unit == 1 else vectors / unit - middle / unit, level)
    levels = [x for nodes, links in graph for x in (nodes.tobytes(), links.tobytes())]
    return pa.table(
        [pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([vectors.tobytes()]), pa.array([levels], pa.list_(pa.binary()))],
        names=["dim", "shard", "ids", "vectors", "levels"],
    )


def search_shards(k: int, beam: int):
    """mapInArrow over (an index row, a block of queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a few rows each: both sides are blocks
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                dim = row["dim"].as_py()
                vectors = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, dim)
                parts = [np.frombuffer(x.as_buffer(), np.int32) for x in row["levels"].values]
                graph = [(parts[j], parts[j + 1].reshape(len(parts[j]), -1)) for j in range(0, len(parts), 2)]
                ids = row["ids"].as_py()
                own = np.asarray(row["query_ids"].values)
                queries = np.asarray(row["queries"].values.flatten(), dtype=np.float64).reshape(-1, dim)
                middle, unit = centred(vectors)
                unit = max(unit, top) if (top := float(np.abs(queries).max())) > 1e140 else unit
                vectors, queries = vectors / unit, queries / unit
                near = search_graph(vectors - middle / unit, graph, queries - middle / unit, beam)
                exact = np.sqrt(((vectors[np.maximum(near, 0)] - queries[:, None, :]) ** 2).sum(2)) * unit
                out = []
                for q, places, d in zip(own.tolist(), near.tolist(), exact.tolist(), strict=True):
                    mine: dict[int, float] = {}
                    for s, v in sorted((s, v) for p, s in zip(places, d, strict=True) if p >= 0 for v in ids[p] if v != q):
                        if len(mine) == k:
                            break
                        mine.setdefault(v, s)
                    out += [(q, v, s) for v, s in mine.items()]
                cols = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0)
    )


def build_index(rows: DataFrame, k: int = 10) -> DataFrame:
    """INDEX rows, one for each shard."""
    vectors = usable(rows)
    # -0.0 and 0.0 are one value; the k + 1 smallest ids of a vector are all that a result can name
    vectors = vectors.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    ranked = vectors.withColumn("h", F.xxhash64("embedding")).groupBy("h", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    some = ranked.agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    distinct = some.groupBy("embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    distinct = materialize(distinct, "vectors")
    shards = max(1, -(-distinct.count() // SHARD))
    dealt = distinct.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "ids", "embedding", F.xxhash64(F.lit(5), "embedding").alias("place"))
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(index_shard, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query against every shard, merged."""
    asked = usable(queries).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = asked.groupBy("dim", "block").agg(F.collect_list("vec_id").alias("query_ids"), F.collect_list("embedding").alias("queries"))
    # the stated queries, in blocks, go to each shard
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    tasks = asked.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).join(index, ["dim", "shard"])
    tasks = tasks.select("dim", "ids", "vectors", "levels", "query_ids", "queries")
    found = tasks.mapInArrow(search_shards(k, beam), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
