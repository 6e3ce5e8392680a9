"""Shortest paths in rounds against a queue."""

import heapq
import random

from voxelith.operators import paths


def plain(edges, sources):
    near, out = {}, {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    for key in {s[1] for s in sources}:
        best, todo = {}, [(d, n) for n, k, d in sources if k == key]
        heapq.heapify(todo)
        while todo:
            far, node = heapq.heappop(todo)
            if node in best:
                continue
            best[node] = far
            for b, w in near.get(node, []):
                heapq.heappush(todo, (far + w, b))
        out |= {(n, key): d for n, d in best.items()}
    return out


def test_lengths_from_two_sources(spark):
    for seed, width in ((1, None), (2, 0.0), (3, 1e9)):
        rng = random.Random(seed)
        edges = [(rng.randrange(40), rng.randrange(40), rng.choice([0.0, 0.25, 1.0, rng.random() * 5])) for _ in range(60)]
        sources = [(0, "a", 0.5), (1, "b", 0.0), (2, "b", 3.0), (99, "b", 0.0)]
        got = paths.shortest(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(sources, "node long, source string, dist double"), width)
        assert {(r["node"], r["source"]): r["dist"] for r in got.collect()} == plain(edges, sources)


def test_no_edges_and_no_sources(spark):
    none = spark.createDataFrame([], "a long, b long, weight double")
    one = spark.createDataFrame([(3, 1, 2.0)], "node long, source int, dist double")
    assert [tuple(r) for r in paths.shortest(none, one).collect()] == [(3, 1, 2.0)]
    assert paths.shortest(none, one.filter("node = 0")).count() == 0


def test_blocks_tell_each_other_lengths(spark):
    """Blocks of about nine ways, on a graph whose paths change blocks often."""
    rng = random.Random(4)
    edges = [(rng.randrange(50), rng.randrange(50), rng.choice([0.0, 0.1, 0.7, rng.random()])) for _ in range(90)]
    sources = [(3, True, 0.5), (44, False, 0.0), (17, False, 0.2), (77, True, 1.0)]
    for width in (None, 0.3):
        got = paths.shortest(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(sources, "node long, source boolean, dist double"), width, at_once=9)
        assert {(r["node"], r["source"]): r["dist"] for r in got.collect()} == plain(edges, sources)


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """A chain of 120 edges in 4 blocks is written a few times, not once for every other edge."""
    names, real = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name="step": names.append(name) or real(df, name))
    chain = spark.range(120).selectExpr("id as a", "id + 1 as b", "1.0d as weight")
    for more in ({}, {"at_once": 60}):
        names.clear()
        got = paths.shortest(chain, spark.createDataFrame([(0, "a", 0.0), (120, "b", 0.0)], "node long, source string, dist double"), **more)
        assert {(r["node"], r["source"]): r["dist"] for r in got.collect()} == {(k, s): float(d) for k in range(121) for s, d in (("a", k), ("b", 120 - k))}
        assert len(names) < 12
