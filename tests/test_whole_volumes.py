"""Block-wise kernels give what the whole volume gives, wherever blocks fall."""

import numpy as np

from voxelith.grid import Grid
from voxelith.operators import distance


def cells(df, column):
    return {(r["x"], r["y"], r["z"]): r[column] for r in df.collect()}


def test_h_convex_seeds_of_a_long_ridge(spark):
    g = Grid(200, 1, 1)
    ridge = spark.createDataFrame([(x, 0, 0, 6.0 if x >= 150 else 5.0) for x in range(200)], "x int, y int, z int, dist double")
    assert cells(distance.h_convex_seeds(ridge, g), "seed") == {(x, 0, 0): 1 for x in range(150, 200)}


def test_h_convex_seeds_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    g = Grid(14, 11, 9)
    rows = [(x, y, z, float(v)) for (z, y, x), v in np.ndenumerate(rng.integers(0, 9, (9, 11, 14)) / 2)]
    vox = spark.createDataFrame(rows, "x int, y int, z int, dist double")
    whole, parts = (cells(distance.h_convex_seeds(vox, g, edge=e, halo=1), "seed") for e in (64, 3))
    assert whole and whole == parts


def test_blockwise_watershed_reaches_the_end(spark):
    g = Grid(60, 1, 1)
    rows = [(x, 0, 0, 0.0, 1 if x == 0 else 0) for x in range(60) if x != 57]
    vox = spark.createDataFrame(rows, "x int, y int, z int, cost double, seed int")
    got = cells(distance.blockwise_watershed(vox, g, edge=1, halo=1), "label")
    # the last two voxels lie behind a gap, where no marker is
    assert got == {(x, 0, 0): 1 if x < 57 else 0 for x in range(60) if x != 57}
