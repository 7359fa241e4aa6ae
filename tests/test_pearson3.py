"""Pearson III by likelihood against a plain search, and against the fit by moments."""

import math

import numpy as np
import pytest

from freshet.functions import pearson3 as P


def plain_likelihood(x, g, mean, sd):
    a, b = 4 / g**2, sd * abs(g) / 2
    end, sign = mean - 2 * sd / g, math.copysign(1, g)
    y = [sign * (v - end) for v in x]
    if min(y) <= 0:
        return -math.inf
    return sum((a - 1) * math.log(v) - v / b - a * math.log(b) - math.lgamma(a) for v in y) / len(y)


def samples():
    r = np.random.default_rng(1)
    yield 50 + r.gamma(3.0, 10.0, 400)
    yield -r.gamma(6.0, 2.0, 300)
    yield r.gamma(1.5, 4.0, 60)
    yield r.normal(10, 3, 250)
    yield 1000 + r.gamma(40.0, 1.0, 120)


def test_no_other_parameters_are_likelier():
    r = np.random.default_rng(2)
    values = list(samples())
    for x, found in zip(values, P.fit(values)):
        own = plain_likelihood(x, *found)
        g = ((x - x.mean()) ** 3).mean() / x.std() ** 3 * math.sqrt(len(x) * (len(x) - 1)) / (len(x) - 2)
        assert own >= plain_likelihood(x, g, x.mean(), x.std(ddof=1)) - 1e-12
        for size in (1e-3, 1e-2, 0.1):
            for _ in range(300):
                other = [v * (1 + size * e) if k else v + size * e for k, (v, e) in enumerate(zip(found, r.normal(size=3)))]
                if 0 < abs(other[0]) <= 2:  # shapes of at least 1
                    assert plain_likelihood(x, *other) <= own + 1e-6


def test_known_parameters_come_back():
    x = 50 + np.random.default_rng(3).gamma(4.0, 5.0, 20_000)
    g, mean, sd = P.fit([x])[0]
    assert g == pytest.approx(1.0, abs=0.05) and mean == pytest.approx(70, rel=0.01) and sd == pytest.approx(10, rel=0.02)
    assert P.fit([np.array([1.0, 2.0]), np.full(9, 3.0), np.empty(0)]) == [None, None, None]


def test_index_on_spark(spark):
    from freshet.operators import drought as DR

    r = np.random.default_rng(4)
    rows = [(s, f"{1980 + i // 12}-{i % 12 + 1:02d}-01", float(v)) for s in ("a", "b") for i, v in enumerate(r.gamma(2.0, 30.0, 240))]
    df = spark.createDataFrame(rows, "series_id string, m string, value double").selectExpr("series_id", "to_date(m) AS month", "value")
    got = DR.spi(df, 3, distribution="pearson3").where("spi IS NOT NULL").toPandas()
    assert len(got) == 2 * 238 and abs(got.spi.mean()) < 0.05 and got.spi.std() == pytest.approx(1, abs=0.05)
    moments = DR.spi(df, 3, distribution="pearson3_moments").where("spi IS NOT NULL").toPandas()
    both = got.merge(moments, on=["series_id", "month"])
    assert np.corrcoef(both.spi_x, both.spi_y)[0, 1] > 0.99
