"""Registered bootstrap intervals rest on all 2,000 replicates."""

import inspect

import pytest

from freshet.operators import relations as RL
from freshet.plans import load

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["boot_median_ci", "boot_spearman_ci"])
def test_queries_use_2000_replicates(spark, monkeypatch, name):
    asked, own = [], getattr(RL, name)

    def noted(*a, **kw):
        call = inspect.signature(own).bind(*a, **kw)
        call.apply_defaults()
        asked.append(call.arguments["n_boot"])
        return own(*a, **kw)

    monkeypatch.setattr(RL, name, noted)
    load()[f"rel_{name}"].build(spark, SF)
    assert asked == [2000]


def test_spearman_interval_at_2000_replicates(spark):
    """Against resampling in numpy, with ties."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=60), 1)
    y = np.round(x + rng.normal(size=60), 1)
    got = RL.boot_spearman_ci(spark.createDataFrame(pd.DataFrame({"g": "g", "x": x, "y": y})), ["g"], "x", "y").first()
    draws = rng.integers(0, 60, size=(2000, 60))
    rhos = [pd.Series(x[i]).rank().corr(pd.Series(y[i]).rank()) for i in draws]
    lo, hi = np.percentile(rhos, [2.5, 97.5])
    assert got["rho"] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))
    assert abs(got["ci_lo"] - lo) < 0.15 * (hi - lo) and abs(got["ci_hi"] - hi) < 0.15 * (hi - lo)


def weighted_rho(x, y, w):
    """Rank correlation of a sample in which pair i occurs w[i] times, written out row by row."""
    import numpy as np
    import pandas as pd

    a, b = (pd.Series(np.repeat(v, w)).rank() for v in (x, y))
    return a.corr(b) if a.nunique() > 1 and b.nunique() > 1 else None


@pytest.mark.parametrize("block,cell", [(1024, 512), (7, 16)])
def test_spearman_interval_equals_resampling_with_the_same_draws(spark, monkeypatch, block, cell):
    """Every replicate, in one block and in many, with ties that go over blocks and repeated pairs."""
    import zlib

    import numpy as np
    import pandas as pd

    from freshet.operators import bootstrap as B

    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "CELL", cell)
    rng = np.random.default_rng(5)
    reps, frames, want = 60, [], {}
    for name, n in (("a", 150), ("b", 40), ("c", 5)):
        x = np.round(rng.normal(size=n), 1)
        y = np.round(x + rng.normal(size=n))
        x[: n // 3] = 0.5  # a value that a third of the pairs share
        x[:4], y[:4] = 2.0, -1.0
        frames.append(pd.DataFrame({"g": name, "x": x, "y": y}))
        order = np.lexsort((y, x))
        upto = B.draws_before(np.arange(n + 1), n, reps, [B.SEED, zlib.crc32(name.encode())])
        w = np.diff(upto, axis=0)
        assert (w.sum(axis=0) == n).all() and (w >= 0).all()
        rhos = [r for r in (weighted_rho(x[order], y[order], w[:, b]) for b in range(reps)) if r is not None]
        want[name] = np.percentile(rhos, [2.5, 97.5])
    bad = pd.DataFrame({"g": ["a", "a", "d", "d"], "x": [np.nan, np.inf, 1.0, 2.0], "y": [1.0, 1.0, 1.0, 2.0]})
    got = {r["g"]: r for r in B.boot_spearman_ci(spark.createDataFrame(pd.concat([*frames, bad])).repartition(6), ["g"], "x", "y", n_boot=reps).collect()}
    assert set(got) == set(want)
    for name, (lo, hi) in want.items():
        assert got[name]["ci_lo"] == pytest.approx(lo, abs=1e-9) and got[name]["ci_hi"] == pytest.approx(hi, abs=1e-9)


def test_draws_are_multinomial():
    import numpy as np

    from freshet.operators import bootstrap as B

    n, reps = 3000, 4000
    w = np.diff(B.draws_before(np.arange(n + 1), n, reps, [1, 2]), axis=0)
    assert abs(w.mean() - 1) < 1e-12 and abs(w.var(axis=1).mean() - (1 - 1 / n)) < 0.01
    far = np.corrcoef(w[:1500].sum(axis=0), w[1500:].sum(axis=0))[0, 1]
    assert far == pytest.approx(-1)
    some = B.draws_before(np.array([0, 17, 511, 512, 2999, 3000]), n, reps, [1, 2])
    assert (some == np.cumsum(np.vstack([np.zeros((1, reps), int), w]), axis=0)[[0, 17, 511, 512, 2999, 3000]]).all()
