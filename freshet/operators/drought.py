"""Drought indices on monthly series.

Input is monthly: ``(series_id, month DATE, value)`` with the first day of each month.  Use
``monthly_totals`` to get there from daily rows; missing months inside the record total zero.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as D
from ..functions import pearson3
from ..functions import runs as R
from ..functions import stats as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("series_id",)
TIMESCALES = (1, 3, 6, 12, 24, 48)


def val() -> Column:
    return F.col("value")



def monthly_totals(df: DataFrame, keys: Sequence[str] = KEY, value: str = "value", how: str = "sum") -> DataFrame:
    """Dense monthly series from daily rows: totals (0 for empty months) or means (null)."""
    fold = F.coalesce(F.sum(value), F.lit(0.0)) if how == "sum" else F.avg(value)
    m = df.groupBy(*keys, F.to_date(F.trunc("date", "month")).alias("month")).agg(fold.alias("value"))
    span = m.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    out = grid.join(m, [*keys, "month"], "left")
    return out.fillna(0.0, ["value"]) if how == "sum" else out


def rolling_sum(df: DataFrame, k: int, keys: Sequence[str] = KEY) -> DataFrame:
    """``k``-month sums, null until ``k`` months are there; series with under 30 sums drop out."""
    if k not in TIMESCALES:
        raise ValueError(f"timescale must be one of {TIMESCALES}")
    frame = R.ordered(keys, "month").rowsBetween(-(k - 1), 0)
    out = df.select(*keys, "month", F.when(F.count("value").over(frame) == k, F.sum("value").over(frame)).alias("x"))
    return out.select("*", F.count("x").over(Window.partitionBy(*keys)).alias("n_valid")).where("n_valid >= 30")


def spi(df: DataFrame, k: int = 12, keys: Sequence[str] = KEY, distribution: str = "gamma") -> DataFrame:
    """Standardised precipitation index.

    Gamma: location 0, maximum-likelihood shape from mean and mean logarithm.  Pearson III: by maximum
    likelihood with a shape of at least 1 (``pearson3``), or by moments (``pearson3_moments``).
    """
    w = Window.partitionBy(*keys)
    r = rolling_sum(df, k, keys)
    x = F.col("x")
    if distribution == "gamma":
        y = x + 1e-6
        r = r.select("*", F.avg(y).over(w).alias("mu"), F.avg(F.ln(y)).over(w).alias("ml"))
        r = r.withColumn("shape", D.gamma_shape(F.ln("mu") - F.col("ml")))
        r = r.withColumn("cdf", D.gamma_cdf(y, F.col("shape"), F.col("mu") / F.col("shape")))
    elif distribution == "pearson3":
        # A series has as many values as months.
        whole = r.groupBy(*keys).agg(F.collect_list("x").alias("v"))
        fitted = whole.select(*keys, _pearson3_fit("v").alias("p")).select(*keys, "p.*")
        r = r.join(fitted, list(keys), "left").withColumn("cdf", D.pearson3_cdf(x, F.col("g"), F.col("mu"), F.col("sd")))
    elif distribution == "pearson3_moments":
        n = F.col("n_valid").cast("double")
        r = r.select("*", F.avg(x).over(w).alias("mu"), F.stddev_samp(x).over(w).alias("sd"), F.skewness(x).over(w).alias("g1"))
        r = r.withColumn("g", F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
        r = r.withColumn("cdf", D.pearson3_cdf(x, F.col("g"), F.col("mu"), F.col("sd")))
    else:
        raise ValueError(f"unsupported distribution: {distribution}")
    z = D.normal_quantile("cdf")
    return r.select(*keys, "month", F.col("x").alias("total"), F.when(x.isNotNull(), z).alias("spi"))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("g", "mu", "sd")]))
def _pearson3_fit(values: pd.Series) -> pd.DataFrame:
    found = pearson3.fit([np.asarray(v, float) for v in values])
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["g", "mu", "sd"]).astype(float)


def pet_thornthwaite(t: Column) -> Column:
    """Simplified monthly evaporation; undefined below freezing."""
    return F.when(t >= 0, 16 * F.pow(10 * t / 25, F.lit(1.5)))


def pet_hargreaves(t: Column) -> Column:
    return F.greatest(0.0023 * (t + 17.8) * 30, F.lit(0.0))


def climatic_balance(df: DataFrame, keys: Sequence[str] = KEY, method: str = "thornthwaite") -> DataFrame:
    """Monthly input minus evaporation from ``(keys, month, value, t)``; undefined months count 0."""
    pet = {"thornthwaite": pet_thornthwaite, "hargreaves": pet_hargreaves}[method]
    return df.select(*keys, "month", F.coalesce(val() - pet(F.col("t")), F.lit(0.0)).alias("value"))


def spei(df: DataFrame, k: int = 12, keys: Sequence[str] = KEY, method: str = "thornthwaite") -> DataFrame:
    """Standardised balance index from the empirical rank of the rolling balance."""
    w = Window.partitionBy(*keys)
    r = rolling_sum(climatic_balance(df, keys, method), k, keys)
    n = F.col("n_valid")
    below = F.rank().over(w.orderBy(F.col("x").asc_nulls_last())) - 1
    r = r.withColumn("prob", F.when(F.col("x").isNotNull(), below / n))
    p = F.col("prob")
    r = r.withColumn("prob", F.when(p == 0, 1 / (2 * n)).when(p == 1, 1 - 1 / (2 * n)).otherwise(p))
    return r.select(*keys, "month", F.col("x").alias("balance"), "prob", F.when(F.col("x").isNotNull(), D.normal_quantile("prob")).alias("spei"))


def cumulative_departure(df: DataFrame, keys: Sequence[str] = KEY, method: str = "thornthwaite") -> DataFrame:
    """Running departure of the balance from its month normal, over the departure's deviation."""
    b = climatic_balance(df, keys, method).withColumn("m", F.month("month"))
    b = b.withColumn("dep", val() - F.avg(val()).over(Window.partitionBy(*keys, "m")))
    run = F.sum("dep").over(R.upto(keys, "month"))
    return b.select(*keys, "month", S.div(run, F.stddev_samp("dep").over(Window.partitionBy(*keys))).alias("pdsi"))


def aridity(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean annual input over mean annual evaporation; infinite where there is none."""
    y = df.groupBy(*keys, F.year("month").alias("y")).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("p"), F.coalesce(F.sum(pet_thornthwaite(F.col("t"))), F.lit(0.0)).alias("e")
    )
    return y.groupBy(*keys).agg(
        F.when(F.avg("e") > 0, S.div(F.avg("p"), F.avg("e"))).otherwise(F.lit(float("inf"))).alias("aridity_index")
    )


def dry_spells(df: DataFrame, keys: Sequence[str] = KEY, threshold: float = 1.0) -> DataFrame:
    """Runs of rows below a threshold: longest, mean, number, total days and share.

    A record without any counts as one run of length zero.
    """
    m = R.mark_runs(df, val() < threshold, keys, contiguous=False)
    lengths = m.groupBy(*keys, "run_id").agg(F.count_if("run_flag").alias("len"), F.count("*").alias("rows"))
    n = F.count_if(F.col("len") > 0)
    return lengths.groupBy(*keys).agg(
        F.max("len").alias("max_consecutive_dry_days"),
        F.coalesce(S.div(F.sum("len"), n), F.lit(0.0)).alias("mean_consecutive_dry_days"),
        F.greatest(n, F.lit(1)).alias("total_dry_periods"), F.sum("len").alias("total_dry_days"),
        (F.sum("len") / F.sum("rows") * 100).alias("dry_day_percentage"),
    )


def drought_table(
    monthly: DataFrame, keys: Sequence[str] = KEY, timescales: Sequence[int] = (3, 6, 12)
) -> DataFrame:
    """Long table of both standardised indices for several timescales."""
    out = None
    for k in timescales:
        for name, part in ((f"spi_{k}", spi(monthly, k, keys)), (f"spei_{k}", spei(monthly, k, keys))):
            col = name.split("_")[0]
            part = part.where(F.col(col).isNotNull()).select(*keys, "month", F.lit(name).alias("index"), F.col(col).alias("value"))
            out = part if out is None else out.unionByName(part)
    return out
