"""Compact floods by blocks against the queue over the whole volume."""

import numpy as np
import pytest

from voxelith.grid import AXES, Grid
from voxelith.operators import distance, fronts


@pytest.mark.parametrize("seed, shape, levels, compactness, connectivity", [(2, (9, 10, 11), 65536, 0.05, 6), (3, (30, 3, 4), 12, 0.0, 26)])
def test_blocks_come_to_the_queue_of_the_whole(spark, seed, shape, levels, compactness, connectivity):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, levels, shape).astype(float)
    present = rng.random(shape) > 0.2
    cost[tuple(np.argwhere(present)[0])], cost[tuple(np.argwhere(present)[1])] = 0, levels - 1
    markers = np.zeros(shape, int)
    for k, p in enumerate(rng.permutation(np.argwhere(present))[:9]):
        markers[tuple(p)] = 1 + 7 * k % 5
    at = np.argwhere(present)
    size = at.max(axis=0) - at.min(axis=0) + 1
    low, high = at.min(axis=0), at.max(axis=0) + 1
    cut = tuple(slice(a, b) for a, b in zip(low, high, strict=True))
    assert tuple(size) == cost[cut].shape
    want = distance.flood(distance.quantized(cost, 0.0, levels - 1.0)[cut], markers[cut], present[cut], connectivity, "compact", compactness)
    rows = [(int(x), int(y), int(z), float(cost[z, y, x]), int(markers[z, y, x])) for z, y, x in at]
    vox = spark.createDataFrame(rows, "x int, y int, z int, cost double, seed long")
    out = distance.watershed(vox, Grid(*shape[::-1]), connectivity=connectivity, mode="compact", compactness=compactness, edge=4)
    got = {tuple(r[a] for a in AXES): r["label"] for r in out.collect()}
    assert got == {(int(x), int(y), int(z)): int(want[z - low[0], y - low[1], x - low[2]]) for z, y, x in at}


def test_a_volume_is_many_groups(spark):
    """Thin volumes fall into blocks of as many voxels as cubes have."""
    assert fronts.extents((25, 20, 72_000), 64) == (25, 20, 524)
    assert fronts.extents((25, 20, 200), 8) == (8, 8, 8)
    assert fronts.extents((300, 300, 300), 64) == (64, 64, 64)
    vox = spark.range(25 * 20 * 60).selectExpr("cast(id % 25 as int) x", "cast(floor(id / 25) % 20 as int) y", "cast(floor(id / 500) as int) z", "double(id % 7) cost", "if(id % 997 = 0, 1 + id, 0) seed")
    plan = distance.watershed(vox, Grid(25, 20, 60), mode="compact")._jdf.queryExecution().toString()
    assert "bx" in plan and "volume" not in plan
