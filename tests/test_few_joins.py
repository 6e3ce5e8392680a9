"""Distances to the rim need no join; what a flood reads is written once."""

import math
import random

from voxelith.grid import Grid
from voxelith.operators import distance, splits


def volume(spark, dims, seed=4):
    rng = random.Random(seed)
    cells = {(x, y, z): int(rng.random() < 0.3) for x in range(dims[0]) for y in range(dims[1]) for z in range(dims[2])}
    return cells, spark.createDataFrame([(*k, 1 + k[0] // 3, m) for k, m in cells.items()], "x int, y int, z int, label int, mask int")


def test_signed_distance_joins_nothing(spark):
    dims = (5, 6, 7)
    cells, vox = volume(spark, dims)
    out = distance.signed_distance(vox, Grid(*dims))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    near = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    rim = [p for p, m in cells.items() if not m and any(cells.get(tuple(a + b for a, b in zip(p, d, strict=True)), 0) for d in near)]
    for r in out.collect():
        p = (r["x"], r["y"], r["z"])
        d = min(math.dist(p, q) for q in rim)
        assert math.isclose(r["dist"], -d if cells[p] else d, abs_tol=1e-12)


def test_a_mask_without_value_counts_as_inside(spark):
    vox = spark.createDataFrame([(x, 0, 0, m) for x, m in enumerate([0, 0, 1, None])], "x int, y int, z int, mask int")
    got = {r["x"]: r["dist"] for r in distance.signed_distance(vox, Grid(4, 1, 1)).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: -1.0, 3: -2.0}


def test_a_repaired_split_is_read_not_flooded_again(spark):
    dims = (6, 5, 4)
    _, vox = volume(spark, dims)
    g = Grid(*dims)
    out = splits.repair_split(vox, g, distance.signed_distance(vox, g))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan and "Join" not in plan and out.count() == 120
