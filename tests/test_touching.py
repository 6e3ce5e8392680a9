"""Edges counted inside blocks are those of the sides; no row a side leaves its block."""

import random

from voxelith.grid import Grid
from voxelith.operators import neighbours, working


def volume(spark, dims, labels, missing):
    rng = random.Random(4)
    rows = [(x, y, z, rng.choice([None, *range(labels)])) for x in range(dims[0]) for y in range(dims[1]) for z in range(dims[2]) if rng.random() >= missing]
    return spark.createDataFrame(rows, "x int, y int, z int, label long")


def test_edges_equal_those_of_the_sides(spark):
    dims = (7, 6, 9)
    vox, g = volume(spark, dims, 6, 0.2), Grid(*dims)
    for ignored in ((0,), (2, 3)):
        want = neighbours.two_sided(neighbours.one_sided(vox, g, ignored)).select("edge_id", "lo", "hi", "voxels")
        for edge in (3, 64):
            assert sorted(map(tuple, neighbours.touching(vox, g, ignored, edge).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert neighbours.touching(vox.filter("label = 1"), g).isEmpty() and neighbours.touching(vox.limit(0), g).isEmpty()


def test_a_graph_is_built_from_few_rows(spark, monkeypatch):
    """A row a pair and block: with the sides it was one a side and voxel."""
    counted, real = [], neighbours.ranked
    monkeypatch.setattr(working, "one_sided", None, raising=False)
    monkeypatch.setattr(neighbours, "ranked", lambda e, *by: (counted.append(e._jdf.queryExecution().toString()), real(e, *by))[1])
    working.build(volume(spark, (7, 6, 9), 6, 0.0), Grid(7, 6, 9))
    assert len(counted) == 1 and "FlatMapGroupsInArrow" in counted[0]
