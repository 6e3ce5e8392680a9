"""Compact floods in phases against the queue over the whole volume."""

import numpy as np
import pytest

from voxelith.grid import AXES, Grid
from voxelith.operators import certain, distance, fronts


def flooded(spark, seed, shape, levels, compactness, connectivity, markers, edge=4):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, levels, shape).astype(float)
    present = rng.random(shape) > 0.15
    present[0, 0, 0] = present[-1, -1, -1] = True
    cost[0, 0, 0], cost[-1, -1, -1] = 0, levels - 1
    seeds = np.zeros(shape, int)
    for k, p in enumerate(rng.permutation(np.argwhere(present))[:markers]):
        seeds[tuple(p)] = 1 + 7 * k % 50
    want = distance.flood(distance.quantized(cost, 0.0, levels - 1.0), seeds, present, connectivity, "compact", compactness)
    rows = [(int(x), int(y), int(z), float(cost[z, y, x]), int(seeds[z, y, x])) for z, y, x in np.argwhere(present)]
    vox = spark.createDataFrame(rows, "x int, y int, z int, cost double, seed long")
    out = distance.watershed(vox, Grid(*shape[::-1]), connectivity=connectivity, mode="compact", compactness=compactness, edge=edge).collect()
    assert len(out) == len(rows)
    assert {tuple(r[a] for a in AXES): r["label"] for r in out} == {r[:3]: int(want[r[2], r[1], r[0]]) for r in rows}


@pytest.mark.parametrize(
    "seed, shape, levels, compactness, connectivity, markers",
    [(1, (30, 12, 11), 65536, 0.05, 6, 60), (2, (9, 17, 30), 8, 0.5, 6, 90), (3, (12, 12, 12), 2, 2.0, 26, 40), (4, (40, 5, 4), 300, 0.0, 6, 3), (5, (14, 13, 12), 5, 0.3, 6, 0)],
)
@pytest.mark.parametrize("places", [64, 1 << 20])
def test_phases_come_to_the_queue_of_the_whole(spark, monkeypatch, places, seed, shape, levels, compactness, connectivity, markers):
    """Many seeds and few, ties of levels and of distances, places that no seed reaches; blocks that may grow and not."""
    monkeypatch.setattr(certain, "AT_ONCE", places)
    flooded(spark, seed, shape, levels, compactness, connectivity, markers)


def test_dense_seeds_take_no_rounds(spark, monkeypatch):
    """A block tells its neighbours nothing where phases settle all."""
    monkeypatch.setattr(fronts.Front, "settled", None)
    monkeypatch.setattr(fronts, "_rounds", None)
    flooded(spark, 6, (60, 5, 6), 65536, 0.05, 6, 70, edge=6)



def test_query_takes_no_rounds(spark, sf_dir, monkeypatch):
    from collections import Counter

    from voxelith.grid import voxels
    from voxelith.registry import QUERIES

    monkeypatch.setattr(fronts, "_rounds", None)
    vox = voxels(spark, sf_dir).select(*AXES, "signal").toPandas()
    at = tuple(vox[a].to_numpy() for a in "zyx")
    cost, seeds = np.zeros([a.max() + 1 for a in at]), np.zeros([a.max() + 1 for a in at], int)
    cost[at] = vox["signal"]
    z, y, x = np.indices(cost.shape)
    marked = (x % 5 == 2) & (y % 5 == 2) & (z % 5 == 1)
    seeds[marked] = (1 + x // 5 + 5 * (y // 5) + 20 * (z // 5))[marked]
    want = distance.flood(distance.quantized(cost, cost[at].min(), cost[at].max()), seeds, np.ones(cost.shape, bool), 6, "compact")
    assert {r["label"]: r["n"] for r in QUERIES["m08_watershed_compact"](spark, sf_dir).collect()} == Counter(want[at].tolist())
