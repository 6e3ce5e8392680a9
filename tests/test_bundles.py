"""Bundles of lines are bounded in places, whatever the length of an axis."""

import numpy as np

from voxelith.grid import AXES, Grid
from voxelith.operators import distance


def test_bundles_of_long_lines_hold_fewer():
    assert distance.bundle(128) == 4
    for length in (12_000, 72_000, 500_000):
        k = distance.bundle(length)
        assert length << 2 * k <= distance.PLACES < length << 2 * (k + 1)
    assert distance.bundle(1 << 30) == 0


def test_thin_bundles_measure_the_same(spark, monkeypatch):
    monkeypatch.setattr(distance, "PLACES", 30)
    rng = np.random.default_rng(1)
    shape = (7, 5, 9)
    sites = np.argwhere(rng.random(shape) < 0.05)
    frame = lambda p: spark.createDataFrame([tuple(map(int, r[::-1])) for r in p], "x int, y int, z int")
    at = np.argwhere(np.ones(shape))
    got = {tuple(r[a] for a in AXES): r["d2"] for r in distance.squared_distance(frame(at), frame(sites), Grid(*shape[::-1])).collect()}
    assert got == {tuple(map(int, p[::-1])): float(((sites - p) ** 2).sum(axis=1).min()) for p in at}
