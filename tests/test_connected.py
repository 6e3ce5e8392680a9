"""Components of edge tables against a walk over the graph, by one task and by star rounds."""

import numpy as np
import pytest

from voxelith.operators.graph import connected, forest


def components_of(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        if n not in out:
            todo = [n]
            while todo:
                m = todo.pop()
                if m not in out:
                    out[m] = n
                    todo += near[m]
    return out


def test_forest_against_a_walk():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        pairs = rng.integers(-40, 40, (n, 2))
        node, root = forest(pairs[:, 0], pairs[:, 1])
        got = dict(zip(node.tolist(), root.tolist(), strict=True))
        alone = {x: x for x in np.unique(pairs).tolist()}
        assert got == alone | components_of(pairs.tolist())


def graphs():
    rng = np.random.default_rng(6)
    chain = [(int(a), int(b)) for a, b in zip(range(300), range(1, 301), strict=True)]
    rng.shuffle(chain)
    star = [(1000, 1000 + k) for k in range(1, 200)]
    loose = [tuple(p) for p in rng.integers(2000, 2300, (120, 2)).tolist()]
    return [*map(tuple, chain), *star, *loose, (5, 5), (-3, -3), (-7, 4000)]


@pytest.mark.parametrize("at_once", [1 << 20, 50, 3])
def test_components_against_a_walk(spark, at_once):
    df = spark.createDataFrame([(int(a), int(b)) for a, b in graphs()] + [(None, 1), (2, None)], "a long, b long").repartition(5)
    rows = connected(df, at_once=at_once).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(got) == len(rows) and got == components_of(graphs())


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
