"""A volume kept by block: after any edits its graph is the one built anew, and only blocks near an edit are touched."""

import os
import random

import pytest

from voxelith.grid import AXES, Grid
from voxelith.operators import refresh, working


def frame(spark, rows):
    return spark.createDataFrame(rows, "x int, y int, z int, label long")


def volume(rng, dims, labels, missing=0.0):
    return {(x, y, z): rng.randrange(labels) for x in range(dims[0]) for y in range(dims[1]) for z in range(dims[2]) if rng.random() >= missing}


def pairs(df):
    return sorted((r["lo"], r["hi"], r["voxels"], r["minx"], r["maxz"]) for r in df.collect())


def expected(cells):
    """Edges by a plain loop: voxels of either label that touch the other."""
    found = {}
    for (x, y, z), a in cells.items():
        for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
            b = cells.get((x + d[0], y + d[1], z + d[2]))
            if b and a and a != b:
                found.setdefault((min(a, b), max(a, b)), set()).add((a, (x, y, z)))
    return sorted((lo, hi, len(v), min(p[0] for _, p in v), max(p[2] for _, p in v)) for (lo, hi), v in found.items())


def with_box(store):
    return refresh._edges(store.parts())


def test_stored_graph_is_the_built_one(spark):
    rng = random.Random(1)
    cells = volume(rng, (7, 6, 5), 6, 0.1)
    vox, g = frame(spark, [(*k, v) for k, v in cells.items()]), Grid(7, 6, 5)
    built = working.build(vox, g)
    for edge in (3, 16):
        store = refresh.create(vox, g, edge)
        w = refresh.graph(store)
        assert pairs(with_box(store)) == expected(cells)
        assert sorted(w.edges.select("edge_id", "lo", "hi", "voxels").collect()) == sorted(built.edges.collect())
        assert sorted(w.members.collect()) == sorted(built.members.select("label", "working").collect()) and w.next_free == built.next_free


def test_edits_equal_a_build(spark):
    rng = random.Random(2)
    dims = (6, 5, 3)
    cells = volume(rng, dims, 9)
    store = refresh.create(frame(spark, [(*k, v) for k, v in cells.items()]), Grid(*dims), 3)
    w = refresh.graph(store)
    w = working.merge(w, w.edges.filter("edge_id % 5 = 1"))
    for step in range(2):
        rows = [(*rng.choice(list(cells)), rng.choice([0, 3, 4, 20 + step])) for _ in range((1, 5)[step])]
        before, status = dict(cells), {(r["lo"], r["hi"]): (r["edge_id"], r["status"]) for r in w.edges.join(w.status, "edge_id").collect()}
        groups = {r["label"]: r["working"] for r in w.members.collect()}
        for r in sorted(rows, key=lambda r: r[3]):
            cells[r[:3]] = r[3]
        w = refresh.refresh(store, frame(spark, rows + [(99, 0, 0, 5), (None, 0, 0, 5), (0, 0, 0, None)]), w)
        assert {(r["x"], r["y"], r["z"]): r["label"] for r in store.voxels().collect()} == cells
        assert pairs(with_box(store)) == expected(cells) == pairs(refresh._edges(store.parts()))
        got = {(r["lo"], r["hi"]): (r["edge_id"], r["voxels"], r["status"]) for r in w.edges.join(w.status, "edge_id").collect()}
        assert sorted((*k, v[1]) for k, v in got.items()) == [e[:3] for e in expected(cells)]
        assert len({v[0] for v in got.values()}) == len(got)
        changed = {k for k in cells if cells[k] != before[k]}
        touched = {before[k] for k in changed} | {cells[k] for k in changed}
        lost = {before[k] for k in changed} - {0}
        fallen = {groups[a] for a in lost | {a for lo, hi in status for a, b in ((lo, hi), (hi, lo)) if b in lost}}
        for k, v in got.items():
            if k in status:
                assert v[0] == status[k][0]  # numbers stay
                if not set(k) & touched and not {groups[a] for a in k} & fallen:
                    assert v[2] == status[k][1]
        assert {r["label"]: r["working"] for r in w.members.collect()} == {a: a if groups.get(a) in fallen else groups.get(a, a) for a in set(cells.values()) - {0}}


def test_insert_and_vanish(spark):
    line = [1, 1, 2, 3, 3, 3]
    store = refresh.create(frame(spark, [(x, 0, 0, v) for x, v in enumerate(line)]), Grid(6, 1, 1), 2)
    w = refresh.graph(store)
    w = refresh.insert(store, spark.createDataFrame([(2, 0, 0)], "x int, y int, z int"), w)
    assert sorted(tuple(r) for r in w.edges.select("lo", "hi", "voxels").collect()) == [(1, 4, 2), (3, 4, 2)]
    assert sorted(r["label"] for r in w.members.collect()) == [1, 3, 4] and w.next_free == 5
    assert sorted(tuple(r) for r in refresh.nodes(store).collect()) == [(1, 2), (3, 3), (4, 1)]


def test_a_block_without_sides_keeps_none(spark):
    """All sides of the block go with the edit; nothing stale stays in its folder."""
    store = refresh.create(frame(spark, [(0, 0, 0, 1), (1, 0, 0, 2), (2, 0, 0, 0), (3, 0, 0, 0)]), Grid(4, 1, 1), 2)
    w = refresh.refresh(store, frame(spark, [(1, 0, 0, 1)]), refresh.graph(store))
    assert w.edges.isEmpty() and refresh.sides(store).isEmpty() and [tuple(r) for r in w.members.collect()] == [(1, 1)]


def test_nothing_to_do(spark):
    store = refresh.create(frame(spark, [(0, 0, 0, 1), (1, 0, 0, 2)]), Grid(2, 1, 1), 2)
    w = refresh.graph(store)
    for rows in ([], [(0, 0, 0, 1)], [(7, 7, 7, 1)]):
        after = refresh.refresh(store, frame(spark, rows), w)
        assert after.edges.collect() == w.edges.collect() and after.members.collect() == w.members.collect()
    empty = refresh.create(frame(spark, []), Grid(0, 0, 0), 2)
    assert refresh.graph(empty).members.isEmpty()


def test_only_blocks_near_the_edit(spark):
    """Folders of other blocks are neither opened nor written."""
    rng = random.Random(5)
    dims = (16, 8, 8)
    cells = volume(rng, dims, 30)
    store = refresh.create(frame(spark, [(*k, v) for k, v in cells.items()]), Grid(*dims), 4)
    assert len({r["block"] for r in store.voxels().select("block").distinct().collect()}) == 16

    def files(table):
        root = f"{store.path}/{table}".removeprefix("file://")
        return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet")) for d in os.listdir(root) if d.startswith("block=")}

    vox, parts = files("voxels"), files("parts")
    refresh.refresh(store, frame(spark, [(5, 5, 5, 77)]), refresh.graph(store))  # in block (1, 1, 1), at the face of none
    assert {d for d, f in files("voxels").items() if f != vox[d]} == {"block=13"} == {d for d, f in files("parts").items() if f != parts[d]}

    one = spark.createDataFrame([(13,)], "block long")
    read = refresh._within(store.voxels(), refresh.written(refresh._near(store, one)))
    assert read.count() == 5 * 64
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_refinement_equals_the_unstored_one(spark):
    rng = random.Random(8)
    dims = (8, 6, 4)
    cells = volume(rng, dims, 12)
    vox, g = frame(spark, [(*k, v) for k, v in cells.items()]), Grid(*dims)
    finer = frame(spark, [(*k, 1 + (k[0] > 2)) for k in cells])
    store = refresh.create(vox, g, 4)
    w = refresh.graph(store)
    w = working.merge(w, w.edges.filter("edge_id % 6 = 1"))
    out, want = working.refine_at(vox, finer, g, (1, 1, 1), w)
    got = refresh.refine_at(store, finer, (1, 1, 1), w)
    assert sorted(map(tuple, store.voxels().select(*AXES, "label").collect())) == sorted(map(tuple, out.select(*AXES, "label").collect()))
    assert sorted(got.edges.select("lo", "hi", "voxels").collect()) == sorted(want.edges.select("lo", "hi", "voxels").collect())
    assert got.next_free == want.next_free
    assert {r["label"] for r in got.members.collect()} == {r["label"] for r in want.members.collect()}
    assert refresh.refine_at(store, frame(spark, [(*k, 0) for k in cells]), (1, 1, 1), got) is got


def test_a_new_label_may_not_be_a_group(spark):
    store = refresh.create(frame(spark, [(x, 0, 0, x + 1) for x in range(4)]), Grid(4, 1, 1), 2)
    w = refresh.graph(store)
    w = working.merge(w, w.edges.filter("edge_id = 3"))  # 3 and 4 become group 5
    with pytest.raises(ValueError):
        refresh.refresh(store, frame(spark, [(0, 0, 0, 5)]), w)
    assert sorted(r["label"] for r in store.voxels().collect()) == [1, 2, 3, 4]
