"""Hand-checked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.grid import Grid, by_block, grid_of, voxels
from voxelith.operators import agglomeration as ag
from voxelith.operators import components as cc
from voxelith.operators import distance, neighbours, projections, splits, statistics, working
from voxelith.operators.agglomeration import Graph, Options


def volume(spark, dims, cells):
    """Dense volume of zeros with {(x, y, z): label}."""
    nx, ny, nz = dims
    rows = [(x, y, z, cells.get((x, y, z), 0)) for z in range(nz) for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(rows, "x int, y int, z int, label int"), Grid(nx, ny, nz)


def line(spark, n, spans):
    return volume(spark, (n, 1, 1), {(x, 0, 0): label for label, xs in spans.items() for x in xs})


def labels_of(df):
    return {(r["x"], r["y"], r["z"]): r["label"] for r in df.collect()}


def test_connectivity_and_split(spark):
    vox, g = volume(spark, (2, 2, 1), {(0, 0, 0): 1, (1, 1, 0): 1})
    for n, k in ((6, 2), (26, 1)):
        assert cc.component_counts(cc.components(vox, g, n)).collect()[0]["components"] == k
    out = labels_of(cc.split_disconnected(vox, g, 2))
    assert sorted(out.values()) == [0, 0, 1, 2] and out[0, 0, 0] == 1


def test_two_labels_are_counted_apart(spark):
    vox, g = volume(spark, (4, 2, 1), {(0, 0, 0): 1, (0, 1, 0): 1, (2, 0, 0): 2, (3, 1, 0): 2})
    got = {r["label"]: r["components"] for r in cc.component_counts(cc.components(vox, g)).collect()}
    assert got == {1: 1, 2: 2}


def test_largest_component_keeps_its_label(spark):
    vox, g = line(spark, 4, {1: (0, 1, 3)})
    assert [labels_of(cc.split_disconnected(vox, g, 5))[x, 0, 0] for x in range(4)] == [1, 1, 0, 5]


def test_components_meet_across_blocks(spark):
    rng = np.random.default_rng(3)
    cells = {(x, y, z): int(v) for (z, y, x), v in np.ndenumerate(rng.integers(0, 3, (7, 9, 8)))}
    vox, g = volume(spark, (8, 9, 7), cells)
    for n in (6, 26):
        whole = {(r["x"], r["y"], r["z"]): r["component"] for r in cc.components(vox, g, n, edge=32).collect()}
        parts = {(r["x"], r["y"], r["z"]): r["component"] for r in cc.components(vox, g, n, edge=3).collect()}
        assert whole == parts


def test_small_labels(spark):
    vox, _ = line(spark, 7, {10: (0,), 20: (1, 2), 30: (3, 4, 5)})
    for least, expected in ((0, []), (3, [10]), (4, [10, 30])):
        assert sorted(r["label"] for r in statistics.labels_below(vox, least, [0, 20]).collect()) == expected


@pytest.mark.parametrize(
    "spans, selected, largest, expected",
    [
        ({10: (1, 2), 20: (3, 4, 5), 30: (6,)}, [20], False, {20: 31, 30: 31}),
        ({10: (1, 2), 20: (3, 4, 5), 30: (6,)}, [20], True, {20: 31, 10: 31}),
        ({10: (1, 2, 3), 20: (4, 5), 30: (6,)}, [10, 20], False, {10: 31, 20: 31, 30: 31}),
        ({10: (1, 2), 20: (3, 4)}, [10, 20], False, {10: 21, 20: 21}),
        ({10: (1,), 20: (3,)}, [10], False, {}),
    ],
)
def test_merge_with_neighbours(spark, spans, selected, largest, expected):
    vox, g = line(spark, 8, spans)
    out, sets = working.merge_small(vox, g, spark.createDataFrame([(s,) for s in selected], "label int"), largest)
    assert {r["old"]: r["new"] for r in sets.collect()} == expected
    got = labels_of(out)
    for label, xs in spans.items():
        assert all(got[x, 0, 0] == expected.get(label, label) for x in xs)


def test_boundary_split_map(spark):
    cells = {(0, 0, z): 1 for z in range(7)} | {(2, 1, z): 2 for z in range(7)} | {(4, 3, 2): 3}
    vox, g = volume(spark, (5, 4, 7), cells)
    vox = vox.withColumn("mask", F.expr("int(x = 2 and y = 1 and z = 3)"))
    out, splits_ = cc.boundary_consistent(vox, g)
    got = labels_of(out)
    assert [got[2, 1, z] for z in range(7)] == [4, 4, 4, 0, 5, 5, 5] and got[0, 0, 5] == 1 and got[4, 3, 2] == 3
    assert [(r["old"], r["new"]) for r in splits_.collect()] == [(2, [4, 5])]


def graph(sizes, edges, **options):
    return Graph(sizes, [(a, b, t, s, o, p) for a, b, t, s, o, p in edges], Options(**options))


def test_scores():
    e = [(0, 1, 0.4, 2.0, 0.1, 1.0)]
    for options, expected in (
        ({}, 0.3),
        ({"strategy": "open_mean"}, 0.4),
        ({"strategy": "open_fraction"}, 0.2),
        ({"linkage": "sum"}, 0.6),
        ({"bias_size": 10, "bias_strength": 0.3}, 0.54),
    ):
        assert graph({0: 2, 1: 100}, e, **options).score(0, 1) == pytest.approx(expected)


def test_score_columns_agree_with_the_kernel(spark):
    regions = spark.createDataFrame([(0, 2), (1, 100)], "region_id long, n long")
    edges = spark.createDataFrame([(0, 1, 0.4, 2.0, 0.1, 1.0)], "r1 long, r2 long, total_b double, total_a double, open_b double, open_a double")
    for o, expected in ((Options(), 0.3), (Options(strategy="open_mean"), 0.4), (Options(strategy="open_fraction"), 0.2), (Options(linkage="sum"), 0.6), (Options(bias_size=10, bias_strength=0.3), 0.54)):
        assert ag.scored_edges(edges, regions, o).first()["score"] == pytest.approx(expected)


def test_contract_adds_statistics():
    g = graph({0: 10, 1: 20, 2: 30}, [(0, 1, 1, 2, 0.5, 1), (0, 2, 2, 3, 1, 1.5), (1, 2, 4, 5, 2, 2.5)])
    kept = g.join(0, 1)
    assert g.n[kept] == 30 and g.near[kept][2][1:] == [6, 8, 3, 4]


def test_greedy_pairs_cleanup_and_stale_bias():
    one = lambda a, b, v: (a, b, v, 1.0, v, 1.0)
    g = graph(dict.fromkeys(range(4), 1), [one(0, 1, 0.1), one(2, 3, 0.1), one(1, 2, 0.9)])
    g.greedy()
    assert g.merges == 2 and g.root(0) == g.root(1) != g.root(2) == g.root(3)
    g = graph({0: 1, 1: 10, 2: 20}, [one(0, 1, 0.9), one(0, 2, 0.7)], cleanup_size=5, protection=0.3)
    g.greedy()
    g.cleanup()
    assert g.cleanups == 1 and g.root(0) == g.root(2) != g.root(1)
    g = graph({0: 6, 1: 5, 2: 100}, [one(0, 1, 0.0), one(1, 2, 0.6)], bias_size=10, bias_strength=0.3)
    g.greedy()
    assert g.merges == 1 and g.root(0) == g.root(1) != g.root(2)


def test_soft_bias_and_cleanup_on_volumes(spark):
    vox = spark.createDataFrame([(0, 0, 0, 1, 0.5, 0), (1, 0, 0, 2, 0.42, 0), (0, 1, 0, 3, 0.7, 0), (1, 1, 0, 3, 0.18, 0)], "x int, y int, z int, label int, boundary double, mask int")
    g = Grid(2, 2, 1)
    for o, k in ((Options(), 2), (Options(bias_size=2, bias_strength=0.4), 1)):
        assert ag.agglomerate(vox, g, o)[0].select("label").distinct().count() == k
    for b, k in (((0.6, 0.5, 0.5, 0.5), 1), ((0.8, 0.6, 0.6, 0.6), 2)):
        vox = spark.createDataFrame([(x, 0, 0, 1 if x == 0 else 2, v, 0) for x, v in enumerate(b)], "x int, y int, z int, label int, boundary double, mask int")
        o = Options(cleanup_size=2, protection=0.1)
        assert ag.agglomerate(vox, Grid(4, 1, 1), o)[0].select("label").distinct().count() == k


def test_edges_do_not_depend_on_blocks(spark):
    cells = {}
    for z in range(10):
        for y in range(18):
            for x in range(24):
                cells[x, y, z] = 40 if (x + 3 * y + 5 * z) % 37 == 0 else 1 + x // 4 + 6 * (y // 6) + 18 * (z // 5)
    cells[0, 0, 0] = 0
    vox, g = volume(spark, (24, 18, 10), cells)
    a, b = (sorted(map(tuple, neighbours.faces(vox, g, edge=e).collect())) for e in (64, 5))
    assert a == b
    sides = neighbours.one_sided(vox, g, [0, 40])
    assert not sides.filter("label = 40 or neighbour = 40").count()


def test_watershed_keeps_markers_and_covers(spark):
    rows = [(3 + i % 12, -2 + i // 12 % 9, 5 + i // 108, float((i * 17 + i // 23) % 97), 1 if i == 0 else 2 if i == 800 else 0) for i in range(12 * 9 * 8)]
    vox = spark.createDataFrame(rows, "x int, y int, z int, cost double, seed int")
    for mode in ("arrival", "geodesic", "compact"):
        out = labels_of(distance.watershed(vox, Grid(15, 7, 13), mode=mode))
        assert len(out) == len(rows) and set(out.values()) == {1, 2}
        assert all(out[r[0], r[1], r[2]] == r[4] for r in rows if r[4])


def test_marker_outside_domain_is_an_error():
    with pytest.raises(ValueError):
        distance.flood(np.zeros((1, 1, 2), int), np.array([[[1, 0]]]), np.array([[[False, True]]]))


def test_distance_matches_brute_force(spark):
    vox, g = volume(spark, (6, 5, 4), {(1, 2, 3): 1, (5, 0, 0): 1})
    g = Grid(6, 5, 4, 1.0, 2.0, 0.5)
    got = {(r["x"], r["y"], r["z"]): r["d2"] for r in distance.squared_distance(vox, vox.filter("label = 1"), g).collect()}
    for (x, y, z), d in got.items():
        assert d == pytest.approx(min((x - a) ** 2 + 4 * (y - b) ** 2 + 0.25 * (z - c) ** 2 for a, b, c in ((1, 2, 3), (5, 0, 0))))


def test_no_sites_no_distance(spark):
    vox, g = volume(spark, (2, 2, 2), {})
    assert {r["d2"] for r in distance.squared_distance(vox, vox.limit(0), g).collect()} == {None}


def test_seeded_split_of_a_dumbbell(spark):
    solid = {(x, y, z): 1 for x in range(2, 8) for y in range(2, 8) for z in range(2, 6)} | {(x, y, z): 1 for x in range(12, 18) for y in range(2, 8) for z in range(2, 6)} | {(x, 4, 3): 1 for x in range(8, 12)}
    vox, g = volume(spark, (20, 10, 8), solid)
    land = splits.landscape(splits.object_crop(vox, 1, 1, g), g)
    seeds = spark.createDataFrame([(4, 4, 3, 1, 0), (15, 4, 3, 2, 1)], "x int, y int, z int, part int, seq int")
    part = {(r["x"], r["y"], r["z"]): r["part"] for r in splits.seeded_split(land, seeds).collect()}
    assert set(part) == set(solid) and part[2, 2, 2] == 1 and part[17, 7, 5] == 2


def test_projected_cut_needs_two_parts(spark):
    vox, g = volume(spark, (6, 6, 2), {(x, y, z): 1 for x in range(1, 5) for y in range(1, 5) for z in range(2)})
    flat = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1]]
    assert splits.projected_cut(vox, g, 1, flat, [(0.0, 0.0), (0.1, 0.1)], 0.2).count() == 0
    parts = splits.projected_cut(vox, g, 1, flat, [(2.4, -1.0), (2.4, 9.0)], 0.5)
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {1: 16, 2: 16}


def test_unmerge_splits_a_chain(spark):
    vox, g = line(spark, 8, {1: (0, 1), 2: (2, 3), 3: (4, 5), 4: (6, 7)})
    w = working.build(vox, g)
    w = working.merge(w, w.edges)
    assert w.members.select("working").distinct().count() == 1
    sides = neighbours.one_sided(vox, g)
    at = sides.select(F.least("label", "neighbour").cast("long").alias("lo"), F.greatest("label", "neighbour").cast("long").alias("hi"), "x", "y", "z").join(w.edges, ["lo", "hi"]).groupBy("edge_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    out = working.unmerge(w, 2, statistics.centroids(vox), at)
    m = {r["label"]: r["working"] for r in out.members.collect()}
    assert m[1] == m[2] != m[3] == m[4]
    assert {r["edge_id"]: r["status"] for r in out.status.collect()} == {1: 2, 2: -2, 3: 2}


def test_conversion_rounds_and_clamps(spark):
    rows = spark.createDataFrame([(0.5,), (float("nan"),), (-3.0,), (70000.0,), (1.4,), (None,)], "v double")
    assert [r["value16"] for r in projections.to_16_bit(rows, "v", "cast").collect()] == [1, 0, 0, 65535, 1, 0]


def test_empty_volume(spark):
    vox = spark.createDataFrame([], "x int, y int, z int, label int, boundary double, mask int")
    g = grid_of(vox)
    assert g.dims == (0, 0, 0)
    assert neighbours.region_adjacency(vox, g).count() == 0
    assert statistics.label_counts(vox).count() == 0
    assert by_block(vox, g, lambda t: t, "x int").count() == 0


def test_voxel_view_is_dense(spark, sf_dir):
    vox = voxels(spark, sf_dir)
    g = grid_of(vox)
    assert vox.count() == g.dimx * g.dimy * g.dimz


def test_crofton_surface_of_a_ball(spark):
    from voxelith.plans.segment_table import SHARES, crofton_surface

    assert abs(3 * SHARES[1] + 6 * SHARES[2] + 4 * SHARES[3] - 1) < 1e-9
    r, g = 9, Grid(21, 21, 21)
    rows = [(x, y, z, int((x - 10) ** 2 + (y - 10) ** 2 + (z - 10) ** 2 <= r * r)) for x in range(21) for y in range(21) for z in range(21)]
    got = crofton_surface(spark.createDataFrame(rows, "x int, y int, z int, label int"), g).first()
    assert abs(got["surface"] / (4 * np.pi * (r + 0.05) ** 2) - 1) < 0.03 and abs(got["roundness"] - 1) < 0.03


def test_maurer_distance_of_a_line(spark):
    rows = [(x, 0, 0, int(2 <= x <= 6)) for x in range(9)]
    got = {r["x"]: r["dist"] for r in distance.maurer_distance(spark.createDataFrame(rows, "x int, y int, z int, mask int")).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: -1, 4: -2, 5: -1, 6: 0, 7: 1, 8: 2}
