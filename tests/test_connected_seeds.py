"""Paths between seeds of a class are found in boxes around them, not in one task for the whole object."""

import numpy as np

from voxelith.operators import splits


def test_paths_in_boxes_are_those_of_the_whole(spark):
    rng = np.random.default_rng(5)
    cost = rng.integers(0, 9, (3, 4, 40)) / 8.0
    # the way between the seeds of class 1 has to go around a wall, out of the first box
    wall = np.ones(cost.shape, bool)
    wall[:, :, 1] = False
    wall[2, 3, 1] = True
    first, second = [(0, 0, 0), (0, 0, 3)], [(0, 0, 30), (2, 2, 36)]
    rows = [(int(x), int(y), int(z), 1, float(cost[z, y, x])) for z, y, x in np.argwhere(wall)]
    crop = spark.createDataFrame(rows, "x int, y int, z int, mask int, cost double")
    seeds = spark.createDataFrame([(p[2], p[1], p[0], k, n) for n, (k, p) in enumerate([(1, first[0]), (1, first[1]), (2, second[0]), (2, second[1])])], "x int, y int, z int, part int, seq int")
    got = splits._connected(crop, seeds, (1.0, 1.0, 1.0), reach=1)
    want = splits.split_markers(cost, wall, first, second)
    assert {(r["z"], r["y"], r["x"]): r["part"] for r in got.collect()} == {tuple(map(int, p)): int(want[tuple(p)]) for p in np.argwhere(want)}
