"""Hand-checked orders of merges, and paths between seeds."""

import numpy as np
import pytest

from voxelith.operators import splits
from voxelith.operators.agglomeration import Graph, Options, goes_in_batches


def edge(a, b, mean, area=10.0):
    return (a, b, mean * area, area, mean * area, area)


def test_rank_grows_only_between_equals():
    g = Graph({r: 10 for r in range(4)}, [edge(0, 1, 0.1), edge(1, 2, 0.1), edge(2, 3, 0.1)], Options())
    kept = g.join(1, 2)  # two neighbours each, rank 0 each: the smaller id stays
    assert kept == 1 and g.rank[1] == 1
    g.join(1, 0)
    assert g.rank[1] == 1  # the other had rank 0


def test_of_equally_small_regions_the_better_score_goes_first():
    # 1 and 2 are equally small and near 0 and 3; 2 has the better score and goes first
    edges = [edge(0, 1, 0.45), edge(1, 2, 0.44), edge(2, 3, 0.10)]
    g = Graph({0: 100, 1: 5, 2: 5, 3: 100}, edges, Options(cleanup_size=10, protection=1.0))
    g.cleanup()
    assert g.cleanups == 2
    # 2 went to 3; then 1 prefers the merged region, whose edge to it scores better than that to 0
    assert g.root(2) == g.root(3) == g.root(1) != g.root(0)


def test_equal_scores_go_by_id_and_size_of_the_target():
    edges = [edge(0, 1, 0.2), edge(1, 2, 0.2)]
    g = Graph({0: 50, 1: 5, 2: 60}, edges, Options(cleanup_size=10, protection=1.0))
    g.cleanup()
    assert g.root(1) == g.root(2) != g.root(0)


def test_protection_keeps_a_region_apart():
    g = Graph({0: 50, 1: 5}, [edge(0, 1, 0.9)], Options(cleanup_size=10, protection=0.3))
    g.cleanup()
    assert g.cleanups == 0 and g.root(1) == 1


@pytest.mark.parametrize("edges, o, preview, batched", [(200_000, Options(), False, True), (199_999, Options(), False, False), (200_000, Options(), True, False), (200_000, Options(bias_size=5, bias_strength=1.0), False, False), (200_000, Options(cleanup_size=50), False, False)])
def test_policy(edges, o, preview, batched):
    assert goes_in_batches(edges, o, preview) is batched


def test_seeds_join_the_first_one():
    cost, domain = np.zeros((1, 1, 9)), np.ones((1, 1, 9), bool)
    # the second and third lie on both sides: joined to the first, not in a chain
    got = splits.connect_seeds(cost, domain, [(0, 0, 4), (0, 0, 2), (0, 0, 7)])
    assert got == {(0, 0, k) for k in range(2, 8)}


def test_spacing_decides_between_equal_barriers():
    cost, domain = np.zeros((2, 3, 3)), np.ones((2, 3, 3), bool)
    domain[0, 0, 1] = False  # straight on is closed: over z, or around by y
    near_z = splits.connect_seeds(cost, domain, [(0, 0, 0), (0, 0, 2)], (0.5, 5.0, 1.0))
    near_y = splits.connect_seeds(cost, domain, [(0, 0, 0), (0, 0, 2)], (5.0, 0.5, 1.0))
    assert (1, 0, 1) in near_z and (0, 1, 1) in near_y


def test_seeds_out_of_reach_are_an_error():
    domain = np.ones((1, 1, 5), bool)
    domain[0, 0, 2] = False
    with pytest.raises(ValueError):
        splits.connect_seeds(np.zeros((1, 1, 5)), domain, [(0, 0, 0), (0, 0, 4)])
