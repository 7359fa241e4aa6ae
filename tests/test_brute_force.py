"""Windowed and folded operators against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import distributions as D
from freshet.functions.quantiles import exact_quantiles, ranked_values, spearman, value_ranks
from freshet.operators import baseflow as B
from freshet.operators import clustering as CL
from freshet.operators import drought as DR
from freshet.operators import quality as Q
from freshet.operators import relations as RL
from freshet.operators import response as MR
from freshet.operators import trend as TR


def frame(spark, n=700, seed=0, gap=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        v = 10 + 5 * np.sin(np.arange(n) / 58) + rng.gamma(1, 2, n)
        p, t = rng.gamma(0.4, 6, n), 12 * np.sin(np.arange(n) / 58) + rng.normal(0, 3, n)
        for i in range(n):
            miss = gap and rng.random() < 0.05
            rows.append((s, dt.date(2010, 1, 1) + dt.timedelta(i), None if miss else float(v[i]), float(p[i]), None if miss else float(t[i])))
    return spark.createDataFrame(rows, "series_id string, date date, value double, p double, t double")


def local(df, s="a"):
    return df.where(F.col("series_id") == s).orderBy("date").toPandas()


def filter_once(x, a):
    f, out = x[0], []
    for i, v in enumerate(x):
        if i:
            f = a * f + 0.5 * (1 + a) * (v - x[i - 1])
        out.append(v - f if f >= 0 else v)
    return out


def loop_baseflow(q, a, m=30):
    x = list(q[m:0:-1]) + list(q) + list(q[-2 : -m - 2 : -1])
    x = filter_once(x, a)
    x = filter_once(x[::-1], a)[::-1]
    x = filter_once(x, a)
    return np.maximum(np.array(x[m:-m]), 0)


def test_baseflow_loop(spark):
    df = frame(spark)
    q = local(df)["value"].dropna().to_numpy()
    got = local(B.separate(df, alpha=0.93))["baseflow"].to_numpy()
    assert got == pytest.approx(loop_baseflow(q, 0.93))
    assert (got >= 0).all() and len(got) == len(q)
    bfi = {r["series_id"]: r["bfi"] for r in B.baseflow_index(df, samples=8).collect()}
    want = np.mean([loop_baseflow(q, a).mean() / q.mean() for a in B.ensemble_alphas(8)])
    assert bfi["a"] == pytest.approx(want)
    with pytest.raises(ValueError):
        B.separate(df, alpha=0.5)


def test_two_parameter_filter_loop(spark):
    df = frame(spark)
    q = local(df)["value"].dropna().to_numpy()
    a, cap = {r["series_id"]: r["alpha"] for r in B.recession_constant(df).collect()}["a"], 0.8
    b = [q[0]]
    for v in q[1:]:
        b.append(max(0.0, min(v, ((1 - cap) * a * b[-1] + (1 - a) * cap * v) / (1 - a * cap))))
    got = {r["series_id"]: r["bfi"] for r in B.two_parameter_index(df).collect()}["a"]
    assert got == pytest.approx(np.mean(b) / q.mean())


def test_snow_storage_loop(spark):
    df = frame(spark)
    got = local(MR.snow_partition(df))
    pack = 0.0
    for r in got.itertuples():
        if pd.isna(r.p) or pd.isna(r.t):
            assert r.snowpack_proxy == pytest.approx(pack, abs=1e-9)
            continue
        snow = r.p if r.t <= 0 else 0.0
        pack += snow
        melt = min(pack, 3 * r.t) if r.t > 0 and pack > 0 else 0.0
        pack -= melt
        assert (r.melt_input, r.snowpack_proxy) == (pytest.approx(melt, abs=1e-9), pytest.approx(pack, abs=1e-9))


def test_rolling_spikes_match_pandas(spark):
    df = frame(spark, n=200)
    v = local(df).dropna(subset=["value"]).set_index("date")["value"]
    med = v.rolling(30, center=True, min_periods=10).median()
    mad = v.rolling(30, center=True, min_periods=10).apply(lambda x: np.median(np.abs(x - np.median(x))), raw=True)
    want = ((v - med).abs() / (1.4826 * mad)).dropna()
    got = local(Q.spike_scores(df)).set_index("date")["n_sigma"]
    assert got.to_numpy() == pytest.approx(want.loc[got.index].to_numpy())
    assert len(got) == len(want)


def test_annual_variance_identity(spark):
    df = frame(spark, n=1500)
    v = local(df).dropna(subset=["value"])
    d = pd.to_datetime(v["date"])
    hy = d.dt.year + (d.dt.month >= 10)
    for r in Q.annual_variance(df).where("series_id = 'a'").collect():
        if r["longterm_variance"] is not None:
            assert r["year_variance"] == pytest.approx(v["value"][(hy == r["hydro_year"]).to_numpy()].var())
            assert r["longterm_variance"] == pytest.approx(v["value"][(hy != r["hydro_year"]).to_numpy()].var())


@pytest.mark.parametrize("n", [3, 4, 40, 301])
def test_median_slope_without_holding_pairs(n):
    rng = np.random.default_rng(n)
    for y in (rng.normal(size=n), np.round(rng.normal(size=n)), np.arange(n) * 1.0):
        s = [(y[j] - y[i]) / (j - i) for i in range(n) for j in range(i + 1, n)]
        assert TR._median_slope(y) == pytest.approx(np.median(s))
        assert TR._median_slope(y, limit=50) == pytest.approx(np.median(s))


def test_best_split_matches_loop(spark):
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.normal(0, 1, 60), rng.normal(4, 1, 60)])
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(y)]
    got = TR.binary_segmentation(spark.createDataFrame(rows, "series_id string, date date, value double"), max_points=1).first()
    s = pd.Series(y)
    n = len(y) - 1

    def score(c):
        return 1 - (c * s[:c].var() + (n - c) * s[c:n].var()) / (n * s[:n].var())

    best = max(range(10, n - 10), key=score)
    assert (got["index"], got["score"]) == (best, pytest.approx(score(best)))


def test_pettitt_definition(spark):
    rng = np.random.default_rng(2)
    y = np.round(np.concatenate([rng.normal(0, 1, 30), rng.normal(1, 1, 30)]), 1)
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(y)]
    got = TR.pettitt(spark.createDataFrame(rows, "series_id string, date date, value double")).first()
    u = [abs(np.sign(y[:t, None] - y[None, t:]).sum()) for t in range(1, len(y))]
    assert got["kt_statistic"] == max(u) and got["change_point_index"] == u.index(max(u)) + 1


def test_distributions():
    assert D.norm_cdf(np.array([0, 1.959964, -1.959964])) == pytest.approx([0.5, 0.975, 0.025], abs=1e-6)
    assert D.norm_ppf(np.array([0.5, 0.975, 0.001])) == pytest.approx([0, 1.959964, -3.090232], abs=1e-6)
    assert D.t_sf2(np.array([2.228139, 12.7062]), np.array([10, 1])) == pytest.approx([0.05, 0.05], abs=1e-5)
    assert 1 - D.inc_gamma(np.array([5.0]), np.array([18.307 / 2])) == pytest.approx([0.05], abs=1e-5)
    assert D.f_cdf(np.array([3.3258, 1.0]), np.array([5, 7]), np.array([10, 7])) == pytest.approx([0.95, 0.5], abs=1e-4)
    assert D.digamma(np.array([1.0, 5.5])) == pytest.approx([-0.5772156649, 1.6110931486], abs=1e-9)
    assert D.trigamma(np.array([1.0])) == pytest.approx([np.pi**2 / 6], abs=1e-9)
    x = np.linspace(0.1, 9, 9)
    assert D.inc_gamma(1.0, x) == pytest.approx(1 - np.exp(-x))


def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["hot"] * 6000 + ["cold"] * 7 + ["one"], "v": np.concatenate([np.round(rng.gamma(1, 3, 6000), 1), rng.normal(size=7), [4.0]])})
    df = spark.createDataFrame(pdf).repartition(6)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.977}).collect()}
    for g, s in pdf.groupby("g")["v"]:
        assert [got[g][c] for c in "abc"] == pytest.approx(list(s.quantile([0.1, 0.5, 0.977])))
    ranks = value_ranks(df, ["g"], "v").where("g = 'hot'").toPandas()
    assert (ranks["hi"] - ranks["lo"] + 1).sum() == 6000 and ranks["hi"].max() == 6000
    want = spark.createDataFrame([("hot", r) for r in (1, 17, 3000, 6000)], "g string, rank bigint")
    picked = {r["rank"]: r["v"] for r in ranked_values(df, ["g"], "v", want).collect()}
    s = np.sort(pdf[pdf.g == "hot"]["v"].to_numpy())
    assert picked == {r: s[r - 1] for r in (1, 17, 3000, 6000)}


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=500), 1)
    y = np.round(x + rng.normal(size=500), 1)
    df = spark.createDataFrame(pd.DataFrame({"g": "g", "x": x, "y": y}))
    got = spearman(df, ["g"], "x", "y").first()
    assert got["rho"] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))


def test_bootstrap_median_matches_resampling(spark):
    rng = np.random.default_rng(9)
    v = rng.gamma(2, 3, 80)
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
    r = RL.boot_median_ci(df, ["g"], "v", n_boot=3000).first()
    meds = np.median(v[rng.integers(0, 80, size=(3000, 80))], axis=1)
    assert r["median"] == pytest.approx(np.median(v))
    spread = np.percentile(meds, 97.5) - np.percentile(meds, 2.5)
    assert abs(r["ci_lo"] - np.percentile(meds, 2.5)) < 0.2 * spread
    assert abs(r["ci_hi"] - np.percentile(meds, 97.5)) < 0.2 * spread
    assert RL.boot_median_ci(df.repartition(3), ["g"], "v", n_boot=3000).first() == r


def test_gamma_index_is_standardised(spark):
    rng = np.random.default_rng(0)
    rows = [("a", dt.date(1990 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(rng.gamma(3, 20, 360))]
    df = spark.createDataFrame(rows, "series_id string, month date, value double")
    for k in (1, 3):
        z = np.array([r["spi"] for r in DR.spi(df, k).collect() if r["spi"] is not None])
        assert abs(z.mean()) < 0.1 and 0.85 < z.std() < 1.15 and len(z) == 361 - k
    with pytest.raises(ValueError):
        DR.spi(df, 5)
    g = DR.spi(df, 1).join(DR.spi(df, 1, distribution="pearson3").withColumnRenamed("spi", "p3"), ["series_id", "month"])
    assert g.agg(F.corr("spi", "p3")).first()[0] > 0.98


def test_adjusted_rand_extremes(spark):
    df = spark.createDataFrame([(i % 3, i % 3, i % 2) for i in range(60)], "a int, b int, c int")
    assert CL.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1.0)
    assert abs(CL.adjusted_rand(df, "a", "c").first()["ari"]) < 0.05


def test_results_do_not_depend_on_partitioning(spark):
    from freshet.operators import grading as G

    df = frame(spark, n=1600)
    a = G.year_table(G.assess(df, threshold=8.0)).orderBy("series_id", "hydro_year").collect()
    b = G.year_table(G.assess(df.repartition(7, "p"), threshold=8.0)).orderBy("series_id", "hydro_year").collect()
    assert len(a) > 0 and [r["flag_codes"] for r in a] == [r["flag_codes"] for r in b]
