"""Merges by tables against the loops of ``Graph`` on whole graphs."""

import random

import pytest

from voxelith.operators import agglomeration as ag
from voxelith.operators.agglomeration import Graph, Options


def random_graph(seed, regions, ties):
    rng = random.Random(seed)
    at, edges = rng.sample(range(10 * regions), regions), {}
    for k, a in enumerate(at):
        for b in rng.sample(at[:k], min(k, rng.randrange(1, 4))):
            area = rng.choice([1.0, 2.0, 4.0]) if ties else rng.uniform(0.5, 5)
            mean = rng.choice([0.1, 0.3, 0.7]) if ties else rng.uniform(0.05, 0.9)
            edges[min(a, b), max(a, b)] = (min(a, b), max(a, b), mean * area, area, mean * area, area)
    return {a: rng.randrange(1, 200) for a in at}, sorted(edges.values())


def frames(spark, sizes, edges):
    return spark.createDataFrame(list(sizes.items()), "region_id long, n long"), spark.createDataFrame(edges, "r1 long, r2 long, total_b double, total_a double, open_b double, open_a double")


def groups(roots):
    out = {}
    for r, k in roots.items():
        out.setdefault(k, set()).add(r)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("ties, at_once", [(False, 10), (True, 0)])
def test_batches_of_tables_are_those_of_the_loop(spark, ties, at_once):
    sizes, edges = random_graph(2, 30, ties)
    g = Graph(sizes, edges, Options())
    g.batched()
    rows = ag.batched_roots(*frames(spark, sizes, edges), Options(), at_once).collect()
    assert {r["region_id"]: r["root"] for r in rows} == {r: g.root(r) for r in sizes}
    assert max(r["batches"] for r in rows) == g.batches and max(r["most"] for r in rows) == g.most


def test_rounds_come_to_the_strict_partition(spark):
    """Hundreds of graphs at once: they are components of one."""
    o, sizes, edges, want = Options(strategy="open_fraction", cleanup_size=60, protection=0.1), {}, [], []
    for seed in range(300):
        s, e = random_graph(seed, 4 + seed % 20, False)
        base = seed * 1000
        s, e = {a + base: n for a, n in s.items()}, [(a + base, b + base, *x) for a, b, *x in e]
        g = Graph(s, e, o)
        g.greedy()
        g.cleanup()
        want += groups({r: g.root(r) for r in s})
        sizes |= s
        edges += e
    rows = ag.agglomerate_graph(*frames(spark, sizes, edges), o, at_once=30).collect()
    assert groups({r["region_id"]: r["root"] for r in rows}) == sorted(want)


def test_cleanup_is_never_dropped(spark):
    """Large by its number of edges, but sizes count: strict order, and the small regions go."""
    from voxelith.grid import grid_of, voxels

    vox = voxels(spark, "/root/testdata/sf0.001")
    o = Options(tau=0.05, cleanup_size=90, protection=1.0)
    one = ag.agglomerate(vox, grid_of(vox), o, least=1)[1].first().asDict()
    assert one == ag.agglomerate(vox, grid_of(vox), o)[1].first().asDict()
    assert one["batched"] == 0 and one["cleanups"] > 0 and one["clusters"] == one["regions"] - one["merges"] - one["cleanups"]
    with pytest.raises(ValueError):
        ag.batched_roots(None, None, o)


def test_empty_graph(spark):
    regions, edges = frames(spark, {3: 1, 5: 2}, [])
    for f in (ag.batched_roots, ag.agglomerate_graph):
        assert {r["region_id"]: r["root"] for r in f(regions, edges, Options()).collect()} == {3: 3, 5: 5}
