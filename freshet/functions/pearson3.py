"""Pearson III distributions fitted by maximum likelihood, all groups of a batch at once.

For a given end point the best shape and scale are those of a gamma distribution, so the likelihood is followed along the
end point alone: on a grid from close to the data to far away, then by golden sections around the best place, for data
and mirrored data.  The shape is at least 1, as below it the likelihood grows without bound towards the end point; the fit by
moments is kept where it is better.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from .distributions import digamma, log_gamma, trigamma

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = np.arange(-16.0, 6.01, 0.25)  # logarithm of the end point's distance in deviations
SECTIONS = 45
LEAST_SHAPE = 1.0


def best_shape(s: np.ndarray) -> np.ndarray:
    """Gamma shape whose log mean less mean log is ``s``."""
    s = np.maximum(s, 1e-12)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(6):
        inverse = 1 / a + (np.log(a) - digamma(a) - s) / (a * a * (1 / a - trigamma(a)))
        a = np.where(inverse > 0, 1 / np.where(inverse > 0, inverse, 1.0), a / 2)
    return a


def log_likelihood(x: np.ndarray, shape: float, scale: float, end: float, sign: float) -> float:
    """Mean log density of ``sign * (x - end)`` as gamma; minus infinity beyond the end point."""
    y = sign * (x - end)
    if (y <= 0).any():
        return -np.inf
    return float(((shape - 1) * np.log(y) - y / scale).mean() - shape * np.log(scale) - log_gamma(np.array([shape]))[0])


class _Profile:
    def __init__(self, values: list[np.ndarray]):
        self.n = np.array([len(v) for v in values])
        self.x = np.concatenate(values)
        self.starts = np.cumsum(self.n) - self.n
        self.low = np.minimum.reduceat(self.x, self.starts)
        mean = np.add.reduceat(self.x, self.starts) / self.n
        self.sd = np.sqrt(np.add.reduceat((self.x - np.repeat(mean, self.n)) ** 2, self.starts) / self.n)

    def at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean log-likelihood, shape, scale and end point for the end point at distance ``exp(t)`` deviations."""
        end = self.low - self.sd * np.exp(t)
        y = self.x - np.repeat(end, self.n)
        mean, logs = np.add.reduceat(y, self.starts) / self.n, np.add.reduceat(np.log(y), self.starts) / self.n
        a = np.maximum(best_shape(np.log(mean) - logs), LEAST_SHAPE)
        return (a - 1) * logs - a - a * np.log(mean / a) - log_gamma(a), a, mean / a, end

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        scores = np.stack([self.at(np.full(len(self.n), t))[0] for t in GRID])
        middle = GRID[scores.argmax(axis=0)]
        lo, hi = middle - 0.25, middle + 0.25
        ratio = (np.sqrt(5) - 1) / 2
        for _ in range(SECTIONS):
            p, q = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            up = self.at(p)[0] < self.at(q)[0]
            lo, hi = np.where(up, p, lo), np.where(up, hi, q)
        fine, coarse = self.at((lo + hi) / 2), self.at(middle)
        better = fine[0] >= coarse[0]
        return tuple(np.where(better, f, c) for f, c in zip(fine, coarse))


def fit(values: list[np.ndarray]) -> list[tuple[float, float, float] | None]:
    """``(skew, mean, deviation)`` of every group; None for fewer than three values or no spread."""
    out: list[tuple[float, float, float] | None] = [None] * len(values)
    some = [i for i, v in enumerate(values) if len(v) > 2 and np.ptp(v) > 0]
    if not some:
        return out
    sides = [(sign, _Profile([sign * values[i] for i in some]).best()) for sign in (1.0, -1.0)]
    for k, i in enumerate(some):
        x = values[i]
        n, mean, sd = len(x), x.mean(), x.std(ddof=1)
        found = []
        for sign, (like, a, b, end) in sides:
            if np.isfinite(like[k]):
                found.append((like[k], sign * 2 / np.sqrt(a[k]), sign * (end[k] + a[k] * b[k]), np.sqrt(a[k]) * b[k]))
        g = ((x - mean) ** 3).mean() / x.std() ** 3 * np.sqrt(n * (n - 1)) / (n - 2)
        if g != 0:
            shape, scale = 4 / g**2, sd * abs(g) / 2
            found.append((log_likelihood(x, shape, scale, mean - 2 * sd / g, np.sign(g)), g, mean, sd))
        found.append((-np.inf, g, mean, sd))  # the moments where no end point lies beyond all values
        out[i] = tuple(float(v) for v in max(found, key=lambda f: f[0])[1:])
    return out
