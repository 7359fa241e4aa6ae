"""Aggregate expressions shared by the operators.

Two conventions are kept apart on purpose: ``stddev_pop`` where the metric divides by n and
``stddev_samp`` where it divides by n - 1.  Division goes through ``div`` because ANSI mode
raises on a zero denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def div(a: Column | float, b: Column | float) -> Column:
    """Null instead of an error for a zero denominator."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def div_pos(a: Column, b: Column) -> Column:
    """Ratio only where the denominator is positive."""
    return F.when(b > 0, div(a, b))


def quantile(c: Column | str, p: float) -> Column:
    """Exact linear-interpolated quantile of a group whose size the calendar bounds."""
    return F.percentile(F.col(c) if isinstance(c, str) else c, F.lit(float(p)))


def cv_pop(c: Column | str) -> Column:
    return div(F.stddev_pop(c), F.avg(c))


def cv_samp(c: Column | str) -> Column:
    return div(F.stddev_samp(c), F.avg(c))


def std_from_sums(c: Column | str) -> Column:
    """Sample deviation that does not depend on the order of rows, for whole numbers whose squares add up below 2^53."""
    v = F.col(c) if isinstance(c, str) else c
    n = F.count(v)
    return F.when(n > 1, F.sqrt(F.greatest(n * F.sum(v * v) - F.sum(v) * F.sum(v), F.lit(0.0)) / (n * (n - 1))))


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs, null for a constant side (ANSI mode would raise)."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def adjusted_skew(c: Column | str) -> Column:
    """Bias-adjusted skewness (Spark's built-in is the population moment)."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(c: Column | str) -> Column:
    """Bias-adjusted excess kurtosis."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities into NULL in every floating column, once, at the boundary."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    bad = (float("nan"), float("inf"), float("-inf"))
    return df.select(
        *[
            F.when(~F.col(c).isin(*bad), F.col(c).cast("double")).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide metrics to ``(ids…, metric, value)``."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(ids), list(values), "metric", "value"
    )
