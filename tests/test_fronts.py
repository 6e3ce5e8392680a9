"""Floods by blocks against the flood of the whole, and against plain Python."""

import numpy as np
import pytest

from voxelith.grid import AXES, Grid, stencil
from voxelith.operators import fronts


def plain(level, markers, rule, connectivity):
    """Take the least key that is left, again and again."""
    keys, todo = {}, {p: (0, 0, int(v)) for p, v in np.ndenumerate(markers) if v}
    given = set(todo)
    while todo:
        at = min(todo, key=lambda p: todo[p])
        key = keys[at] = todo.pop(at)
        for d in stencil(connectivity):
            to = tuple(a + b for a, b in zip(at, d, strict=True))
            if not all(0 <= t < n for t, n in zip(to, level.shape, strict=True)) or level[to] < 0 or to in keys or to in given:
                continue
            high, steps, label = key
            own = int(level[to])
            new = (high, steps + 1, label) if own <= high else (own, 0 if rule == "arrival" else steps + 1, label)
            if to not in todo or new < todo[to]:
                todo[to] = new
    return keys


def volume(seed, shape, levels, seeds, gaps):
    rng = np.random.default_rng(seed)
    level = rng.integers(0, levels, shape)
    level[rng.random(shape) < gaps] = -1
    markers = np.zeros(shape, int)
    inside = np.argwhere(level >= 0)
    for k, p in enumerate(rng.permutation(inside)[:seeds]):
        markers[tuple(p)] = 1 + 7 * k % 5
    return level, markers


def frame(spark, level, markers):
    rows = [(int(x), int(y), int(z), int(level[z, y, x]), int(markers[z, y, x])) for z, y, x in np.argwhere(level >= 0)]
    return spark.createDataFrame(rows, "x int, y int, z int, level int, marker long")


@pytest.mark.parametrize("rule", fronts.RULES)
@pytest.mark.parametrize("connectivity", [6, 26])
def test_settle_takes_keys_in_order(rule, connectivity):
    for seed in range(12):
        level, markers = volume(seed, (4, 5, 6), 2 + seed % 6 * 3, 1 + seed % 5, 0.25)
        sources = [(int(np.ravel_multi_index(p, level.shape)), 0, 0, int(v)) for p, v in np.ndenumerate(markers) if v]
        high, steps, label = fronts.settle(level, sources, connectivity, rule)
        want = plain(level, markers, rule, connectivity)
        got = {p: (int(high[p]), int(steps[p]), int(label[p])) for p in np.ndindex(level.shape) if high[p] >= 0}
        assert got == want


@pytest.mark.parametrize("rule, connectivity, seed", [("geodesic", 6, 1), ("arrival", 6, 2), ("geodesic", 26, 3)])
def test_blocks_come_to_the_flood_of_the_whole(spark, rule, connectivity, seed):
    level, markers = volume(seed, (9, 10, 11), (5, 40, 12)[seed - 1], 6, 0.3)
    sources = [(int(np.ravel_multi_index(p, level.shape)), 0, 0, int(v)) for p, v in np.ndenumerate(markers) if v]
    high, steps, label = fronts.settle(level, sources, connectivity, rule)
    out = fronts.flood(frame(spark, level, markers), Grid(11, 10, 9), rule, connectivity, edge=4).collect()
    got = {tuple(r[a] for a in AXES): (r["level"], r["steps"], r["label"]) for r in out}
    want = {(int(x), int(y), int(z)): (int(high[z, y, x]), int(steps[z, y, x]), int(label[z, y, x])) if high[z, y, x] >= 0 else (None, None, 0) for z, y, x in np.argwhere(level >= 0)}
    assert got == want


def test_a_snake_through_all_blocks(spark):
    """One way that enters blocks many times, with a short cut that costs a high level."""
    level = np.full((1, 9, 12), -1)
    for y in range(0, 9, 2):
        level[0, y, :] = 3
    for k, y in enumerate(range(1, 9, 2)):
        level[0, y, 11 if k % 2 == 0 else 0] = 3
    level[0, 1, 0] = 9
    markers = np.zeros(level.shape, int)
    markers[0, 0, 0] = 5
    out = {(r["x"], r["y"]): (r["level"], r["steps"]) for r in fronts.flood(frame(spark, level, markers), Grid(12, 9, 1), edge=3).collect()}
    assert out[11, 8] == (3, int((level >= 0).sum()) - 2) and out[0, 1] == (9, 1)


@pytest.mark.parametrize("rule", fronts.RULES)
@pytest.mark.parametrize("connectivity", [6, 26])
def test_whole_fronts_come_to_the_keys_in_order(rule, connectivity):
    """With keys given from outside, some of whose steps are not known yet."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        level, markers = volume(seed, (5, 6, 7), (1, 4, 30, 60000)[seed % 4], 1 + seed % 6, (seed % 3) * 0.2)
        sources = [(int(np.ravel_multi_index(p, level.shape)), int(rng.integers(0, 5)), int(rng.integers(0, 9)), int(v)) for p, v in np.ndenumerate(markers) if v]
        sources[0] = (*sources[0][:2], *fronts.UNKNOWN)
        got, want = (f(level, sources, connectivity, rule == "arrival" if f is fronts._fronts else rule) for f in (fronts._fronts, fronts.settle_in_order))
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        assert (fronts._fronts(level, sources, connectivity, rule == "arrival", True)[0] == want[0]).all()


def test_rounds_do_not_count_steps_up(spark, monkeypatch):
    """A short way on a high level, told across blocks before the long low one is known."""
    level = np.full((1, 2, 40), -1)
    level[0, 0, :] = 5
    level[0, 1, :] = 1
    level[0, 0, 0] = 9
    level[0, 1, 0] = 9
    markers = np.zeros(level.shape, int)
    markers[0, 0, 0], markers[0, 1, 39] = 7, 8
    rounds, real = [], fronts.written
    monkeypatch.setattr(fronts, "written", lambda df, name="step": (rounds.append(name), real(df, name))[1])
    out = {(r["x"], r["y"]): (r["level"], r["steps"], r["label"]) for r in fronts.flood(frame(spark, level, markers), Grid(40, 2, 1), edge=3).collect()}
    sources = [(0, 0, 0, 7), (79, 0, 0, 8)]
    high, steps, label = fronts.settle_in_order(level, sources)
    assert out == {(x, y): (int(high[0, y, x]), int(steps[0, y, x]), int(label[0, y, x])) for x in range(40) for y in range(2)}
    assert rounds.count("told") <= 12
