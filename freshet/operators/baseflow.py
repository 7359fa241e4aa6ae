"""Baseflow separation by recursive digital filters.

The smoothing filter runs over the ordered days of one series, so it is a grouped-pandas step:
Spark partitions by series and each task holds one calendar-bounded series at a time.  The
parameter ensemble is a numpy vector inside the step, not extra rows.  The two-parameter filter
needs only its running total and stays in the JVM as a fold.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions import stats as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("series_id",)
# Parameter range, ensemble seed and size, mirror length, passes.
ALPHA_RANGE = (0.90, 0.98)
SEED, SAMPLES, MIRROR, PASSES = 1996, 1000, 30, 3


def val() -> Column:
    return F.col("value")



def ensemble_alphas(n: int = SAMPLES) -> list[float]:
    return [float(a) for a in np.random.RandomState(SEED).uniform(*ALPHA_RANGE, n)]


def _smooth(x: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """One filter pass along axis 0 for all parameters at once."""
    quick = x[0].copy()
    out = np.empty_like(x)
    out[0] = x[0] - np.maximum(quick, 0.0)
    gain = 0.5 * (1.0 + alphas)
    for i in range(1, len(x)):
        quick = alphas * quick + gain * (x[i] - x[i - 1])
        out[i] = x[i] - np.maximum(quick, 0.0)
    return out


def _separate(q: np.ndarray, alphas: np.ndarray, passes: int, mirror: int) -> np.ndarray:
    """Baseflow averaged over the parameters, clipped at zero per parameter."""
    pad = mirror if len(q) - 1 > mirror else 0
    padded = np.concatenate([q[pad:0:-1], q, q[-2 : -pad - 2 : -1]]) if pad else q
    total = np.zeros(len(q))
    for chunk in np.array_split(alphas, max(1, len(alphas) // 256)):
        base = _smooth(np.repeat(padded[:, None], len(chunk), axis=1), chunk)
        for _ in range((passes - 1) // 2):
            base = _smooth(base[::-1], chunk)[::-1]
            base = _smooth(base, chunk)
        total += np.maximum(base[pad : len(base) - pad], 0.0).sum(axis=1)
    return total / len(alphas)


def separate(
    df: DataFrame, keys: Sequence[str] = KEY, alpha: float | None = None, passes: int = PASSES,
    mirror: int = MIRROR, samples: int = SAMPLES,
) -> DataFrame:
    """Baseflow of every observed day, for one ``alpha`` or averaged over the fixed ensemble."""
    if alpha is not None and not ALPHA_RANGE[0] <= alpha <= ALPHA_RANGE[1]:
        raise ValueError("alpha must lie in 0.90..0.98")
    alphas = np.array([alpha] if alpha is not None else ensemble_alphas(samples))

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(baseflow=_separate(pdf["value"].to_numpy(float), alphas, passes, mirror))

    base = df.where(val().isNotNull()).select(*keys, "date", F.col("value").cast("double").alias("value"))
    schema = base.schema.simpleString()[len("struct<"):-1]
    return base.groupBy(*keys).applyInPandas(one_series, schema.replace(":", " ") + ", baseflow double")


def baseflow_index(df: DataFrame, keys: Sequence[str] = KEY, **kw) -> DataFrame:
    """Mean baseflow over mean flow (0 where the mean flow is 0)."""
    return separate(df, keys, **kw).groupBy(*keys).agg(
        F.when(F.avg(val()) == 0, 0.0).otherwise(S.div(F.avg("baseflow"), F.avg(val()))).alias("bfi")
    )


def baseflow_stats(df: DataFrame, keys: Sequence[str] = KEY, **kw) -> DataFrame:
    b = F.col("baseflow")
    out = separate(df, keys, **kw).groupBy(*keys).agg(
        F.when(F.avg(val()) == 0, 0.0).otherwise(S.div(F.avg(b), F.avg(val()))).alias("bfi"),
        F.avg(b).alias("baseflow_mean"), S.quantile(b, 0.5).alias("baseflow_median"),
        F.stddev_pop(b).alias("baseflow_std"), S.cv_pop(b).alias("baseflow_cv"),
        F.min(b).alias("baseflow_min"), F.max(b).alias("baseflow_max"),
    )
    return out.withColumn("quickflow_ratio", 1.0 - F.col("bfi"))


def index_at_alphas(df: DataFrame, alphas: Sequence[float], keys: Sequence[str] = KEY, min_values: int = 365) -> DataFrame:
    """Baseflow index at several parameters, one column each, in a single pass over the groups."""
    grid = np.array(list(alphas), float)
    names = [f"bfi_a{a:g}".replace(".", "_") for a in alphas]

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.sort_values("date")["value"].to_numpy(float)
        row = {k: [pdf[k].iloc[0]] for k in keys}
        enough = len(q) >= min_values and q.mean() != 0
        for n, a in zip(names, grid):
            row[n] = [_separate(q, np.array([a]), PASSES, MIRROR).mean() / q.mean() if enough else None]
        return pd.DataFrame(row)

    base = df.where(val().isNotNull()).select(*keys, "date", F.col("value").cast("double").alias("value"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name in keys)
    return base.groupBy(*keys).applyInPandas(one_series, types + "".join(f", {n} double" for n in names))


def recession_constant(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 30) -> DataFrame:
    """Median ratio to the previous day on falling days, kept in 0.90..0.99 (0.98 if too few)."""
    prev = F.lag("value").over(R.ordered(keys))
    base = df.where(val().isNotNull()).select(*keys, "value", prev.alias("prev"))
    ratio = F.when((val() < F.col("prev")) & (F.col("prev") > 0), S.div(val(), F.col("prev")))
    return base.groupBy(*keys).agg(
        F.when(F.count(ratio) < min_days, 0.98)
        .otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.90), S.quantile(ratio, 0.5)))).alias("alpha"),
        F.count("*").alias("n_values"),
    )


def two_parameter_index(
    df: DataFrame, keys: Sequence[str] = KEY, bfi_max: float = 0.8, min_values: int = 365
) -> DataFrame:
    """Baseflow index of the two-parameter filter with the recession constant of each series.

    The filter is a fold over the day-ordered values with (baseflow, running total) as state;
    the array holds one series, which the calendar bounds.
    """
    alpha = recession_constant(df, keys)
    arrays = df.where(val().isNotNull()).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "value"))), lambda s: s["value"]).alias("q")
    )
    joined = arrays.join(alpha, list(keys)).where(F.col("n_values") >= min_values)
    a, cap = F.col("alpha"), F.lit(float(bfi_max))
    denom = 1.0 - a * cap
    first = F.element_at("q", 1)

    def step(acc: Column, q: Column) -> Column:
        b = ((1.0 - cap) * a * acc["b"] + (1.0 - a) * cap * q) / denom
        b = F.greatest(F.lit(0.0), F.least(b, q))
        return F.struct(b.alias("b"), (acc["total"] + b).alias("total"))

    rest = F.slice("q", F.lit(2), F.greatest(F.size("q") - 1, F.lit(0)))
    state = F.aggregate(rest, F.struct(first.alias("b"), first.alias("total")), step)
    mean = F.aggregate("q", F.lit(0.0), lambda x, y: x + y) / F.size("q")
    return joined.select(
        *keys, "alpha", F.when(mean == 0, 0.0).otherwise(S.div(state["total"] / F.size("q"), mean)).alias("bfi")
    )
