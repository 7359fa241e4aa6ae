"""Pair counts and median slopes against all pairs."""

import time

import numpy as np
import pytest

from freshet.functions import pairwise as P


def plain(y):
    d = [y[k:] - y[:-k] for k in range(1, len(y))]
    slopes = np.concatenate([x / k for k, x in enumerate(d, 1)]) if d else np.empty(0)
    return int(sum((x > 0).sum() for x in d)), int(sum((x < 0).sum() for x in d)), slopes


def series():
    r = np.random.default_rng(2)
    yield from (r.normal(size=n) for n in (0, 1, 2, 3, 4, 17, 64, 65, 300, 801))
    yield from (r.integers(0, k, size=400).astype(float) for k in (1, 2, 3, 50))
    yield np.arange(500.0)
    yield -np.arange(500.0) / 3
    yield np.repeat([1.0, 2.0, 1.5], 200)
    yield np.cumsum(r.normal(size=700)) + 1e6
    yield r.pareto(0.7, size=600)
    yield np.concatenate([np.zeros(500), r.normal(size=100)])


@pytest.mark.parametrize("i", range(20))
def test_matches_all_pairs(i):
    y = list(series())[i]
    rising, falling, slopes = plain(y)
    assert P.relations(y) == (rising, falling)
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    a, b = P.falling_pairs(rank)
    assert len(a) == falling and (a < b).all() and (y[a] > y[b]).all() and len(set(zip(a, b))) == falling
    if not len(slopes):
        assert P.median_slope(y) is None
        return
    want = np.median(slopes)
    for listed, sample in ((10**6, 10), (2000, 5000), (200, 400), (30, 40)):
        assert P.median_slope(y, listed, sample) == pytest.approx(want, rel=1e-9, abs=1e-12), (listed, sample)


def test_a_long_series_in_seconds():
    r = np.random.default_rng(4)
    n = 60_000
    y = np.round(np.cumsum(r.normal(size=n)) * 0.01 + 2e-5 * np.arange(n) + r.gamma(0.5, size=n), 3)
    t = time.time()
    rising, falling = P.relations(y)
    slope = P.median_slope(y)
    assert time.time() - t < 30
    assert 0 < rising + falling <= n * (n - 1) // 2
    # As many slopes lie on either side of the median.
    below = sum(np.count_nonzero(y[k:] - y[:-k] < k * slope - 1e-12) for k in range(1, n, 97))
    above = sum(np.count_nonzero(y[k:] - y[:-k] > k * slope + 1e-12) for k in range(1, n, 97))
    assert abs(below - above) < 0.01 * (below + above)
