"""A volume kept by block has few folders, however small the blocks asked for."""

import os

from voxelith.grid import Grid
from voxelith.operators import refresh


def line(spark, n):
    return spark.range(n).selectExpr("cast(id as int) as x", "0 as y", "0 as z", "id % 3 as label")


def test_a_store_of_many_blocks_keeps_few_folders(spark):
    n = 400  # 200 blocks of two voxels
    store = refresh.create(line(spark, n), Grid(n, 1, 1), 2)
    root = f"{store.path}/voxels".removeprefix("file://")
    assert 8 < len([d for d in os.listdir(root) if d.startswith("block=")]) <= refresh.FOLDERS
    changes = spark.createDataFrame([(7, 0, 0, 9), (8, 0, 0, 9), (399, 0, 0, 2)], "x int, y int, z int, label long")
    w = refresh.refresh(store, changes, refresh.graph(store))
    cells = [9 if x in (7, 8) else 2 if x == 399 else x % 3 for x in range(n)]
    assert [r["label"] for r in store.voxels().orderBy("x").collect()] == cells
    found = {}
    for x in range(n - 1):
        a, b = cells[x : x + 2]
        if a and b and a != b:
            found.setdefault((min(a, b), max(a, b)), set()).update((x, x + 1))
    assert {(r["lo"], r["hi"]): r["voxels"] for r in w.edges.collect()} == {k: len(v) for k, v in found.items()}
