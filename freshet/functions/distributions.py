"""Distribution functions Spark lacks, as vectorised pandas UDFs over Arrow batches.

Callers aggregate first, so these see one row per series, year or month, never raw records.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions inside the task closure, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOUBLE = T.DoubleType()
LARGE = 1e5  # shape above which the uniform expansion is exact to about 1e-9


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) if v > 0 else np.nan for v in np.ravel(x)]).reshape(np.shape(x))


def _settle(step, n: int) -> None:
    """Call ``step(k)`` for k = 1, 2, … until the relative changes it returns are all negligible (NaN counts as settled)."""
    k = 1
    while n and not np.all(~(step(k) > 1e-15)):
        k += 1


def _large_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) for large a: the leading terms of the uniform expansion around the normal integral."""
    mu = (x - a) / a
    half = np.where(np.abs(mu) < 1e-3, mu**2 / 2 - mu**3 / 3 + mu**4 / 4 - mu**5 / 5, mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2 * np.maximum(half, 0))
    safe = np.where(np.abs(eta) < 1e-2, 1.0, eta)
    c0 = np.where(np.abs(eta) < 1e-2, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864, 1 / np.where(mu == 0, 1.0, mu) - 1 / safe)
    return norm_cdf(eta * np.sqrt(a)) - np.exp(-a * eta**2 / 2) / np.sqrt(2 * np.pi * a) * c0


def inc_gamma(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x).

    Series below a + 1 and continued fraction above, each until it has converged; above ``LARGE``,
    where both get long, the uniform expansion.
    """
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    aa, xx = a[ok], x[ok]
    res = np.zeros(len(aa))
    with np.errstate(all="ignore"):
        big = aa > LARGE
        if big.any():
            res[big] = _large_gamma(aa[big], xx[big])
        low = ~big & (xx < aa + 1.0)
        p, t = aa[low], xx[low]
        term = 1.0 / p
        total = term.copy()

        def series(n: int) -> np.ndarray:
            term[:] = term * t / (p + n)
            total[:] = total + term
            return term / total

        _settle(series, len(p))
        res[low] = np.exp(p * np.log(t) - t - log_gamma(p)) * total
        high = ~big & ~low
        q, u = aa[high], xx[high]
        b, c = u + 1.0 - q, np.full(len(q), 1e300)
        d = 1.0 / b
        h = d.copy()

        def fraction(n: int) -> np.ndarray:
            an = -n * (n - q)
            b[:] = b + 2.0
            e = an * d + b
            d[:] = 1.0 / np.where(np.abs(e) < 1e-300, 1e-300, e)
            e = b + an / c
            c[:] = np.where(np.abs(e) < 1e-300, 1e-300, e)
            h[:] = h * d * c
            return np.abs(d * c - 1.0)

        _settle(fraction, len(q))
        res[high] = 1.0 - np.exp(q * np.log(u) - u - log_gamma(q)) * h
    out[ok] = np.clip(np.where(xx == 0, 0.0, res), 0.0, 1.0)
    return out


def inc_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by the modified Lentz continued fraction, until it has converged."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    shape = a.shape
    a, b, x = a.reshape(-1), b.reshape(-1), x.reshape(-1)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        swap = x > (a + 1.0) / (a + b + 2.0)
        p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(t) + q * np.log1p(-t)) / p
        c = np.ones_like(t)
        d = 1.0 - (p + q) * t / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()

        def pair(m: int) -> np.ndarray:
            change = np.zeros_like(t)
            for num in (
                m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                e = 1.0 + num * d
                d[...] = 1.0 / np.where(np.abs(e) < tiny, tiny, e)
                e = 1.0 + num / c
                c[...] = np.where(np.abs(e) < tiny, tiny, e)
                h[...] = h * d * c
                change = np.maximum(change, np.abs(d * c - 1.0))
            return np.where((t <= 0) | (t >= 1), 0.0, change)

        _settle(pair, t.size)
        res = front * h
        res = np.where(t <= 0, 0.0, res)
        res = np.where(swap, 1.0 - res, res)
    return np.where(np.isnan(x), np.nan, np.clip(res, 0.0, 1.0)).reshape(shape)


def norm_cdf(x) -> np.ndarray:
    x = np.asarray(x, float)
    half = 0.5 * inc_gamma(0.5, x * x / 2.0)
    return np.where(x >= 0, 0.5 + half, 0.5 - half)


def norm_ppf(p) -> np.ndarray:
    """Normal quantile: bisection on the CDF, exact to double precision for practical tails."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -9.0), np.full(p.shape, 9.0)
    erf = np.vectorize(math.erfc, otypes=[float])
    for _ in range(64):
        mid = 0.5 * (lo + hi)
        below = 0.5 * erf(-mid / math.sqrt(2.0)) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    out = 0.5 * (lo + hi)
    out = np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))
    return np.where(np.isnan(p), np.nan, out)


def t_sf2(t, df) -> np.ndarray:
    """Two-sided Student t p-value."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        x = df / (df + t * t)
    p = inc_beta(df / 2.0, 0.5, x)
    return np.where(np.isinf(t), 0.0, p)


def f_cdf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    with np.errstate(all="ignore"):
        x = d1 * f / (d1 * f + d2)
    return inc_beta(d1 / 2.0, d2 / 2.0, x)


@F.pandas_udf(DOUBLE)
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(norm_cdf(x.to_numpy(float)))


@F.pandas_udf(DOUBLE)
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(norm_ppf(p.to_numpy(float)))


@F.pandas_udf(DOUBLE)
def normal_p2(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return pd.Series(2.0 * (1.0 - norm_cdf(np.abs(z.to_numpy(float)))))


@F.pandas_udf(DOUBLE)
def student_p2(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DOUBLE)
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(1.0 - inc_gamma(df.to_numpy(float) / 2.0, x.to_numpy(float) / 2.0))


@F.pandas_udf(DOUBLE)
def f_p2(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Two-sided F p-value."""
    c = f_cdf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float))
    return pd.Series(2.0 * np.minimum(c, 1.0 - c))


@F.pandas_udf(DOUBLE)
def gamma_shape(s: pd.Series) -> pd.Series:
    """Maximum-likelihood gamma shape from ``s = ln(mean) - mean(ln)`` by Newton steps."""
    v = s.to_numpy(float)
    with np.errstate(all="ignore"):
        k = (3.0 - v + np.sqrt((v - 3.0) ** 2 + 24.0 * v)) / (12.0 * v)
        for _ in range(30):
            k = k - (np.log(k) - digamma(k) - v) / (1.0 / k - trigamma(k))
    return pd.Series(k)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = np.where(small, shift - 1.0 / x, shift)
        x = np.where(small, x + 1.0, x)
    i = 1.0 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = np.where(small, shift + 1.0 / (x * x), shift)
        x = np.where(small, x + 1.0, x)
    i = 1.0 / (x * x)
    return shift + 1.0 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


@F.pandas_udf(DOUBLE)
def gamma_cdf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(inc_gamma(shape.to_numpy(float), x.to_numpy(float) / scale.to_numpy(float)))


@F.pandas_udf(DOUBLE)
def pearson3_cdf(x: pd.Series, skew: pd.Series, mean: pd.Series, std: pd.Series) -> pd.Series:
    """Pearson III CDF in skew / mean / standard-deviation form; normal when the skew vanishes."""
    g, z = skew.to_numpy(float), (x.to_numpy(float) - mean.to_numpy(float)) / std.to_numpy(float)
    flat = np.abs(g) < 1e-6
    gg = np.where(flat, 1.0, g)
    a = 4.0 / gg**2
    y = np.maximum(2.0 / gg * (z + 2.0 / gg), 0.0)
    p = inc_gamma(a, y)
    p = np.where(gg < 0, 1.0 - p, p)
    return pd.Series(np.where(flat, norm_cdf(z), p))
