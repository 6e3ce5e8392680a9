"""Envelopes of many lines at once against the minimum over all pairs of places."""

import numpy as np

from voxelith.operators.distance import FAR, lower_envelopes


def test_envelopes_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lines, n = int(rng.integers(1, 7)), int(rng.integers(1, 30))
        f = np.where(rng.random((lines, n)) < rng.random(), rng.integers(0, 60, (lines, n)).astype(float), FAR)
        at = np.sort(rng.choice(120, n, replace=False)).astype(float)
        want = np.minimum((f[:, None, :] + (at[None, :, None] - at[None, None, :]) ** 2).min(axis=2), FAR)
        assert (lower_envelopes(f, at) == want).all()


def test_no_site_on_a_line():
    assert (lower_envelopes(np.array([[FAR, FAR], [FAR, 0.0]]), np.array([0.0, 2.0])) == [[FAR, FAR], [4.0, 0.0]]).all()
