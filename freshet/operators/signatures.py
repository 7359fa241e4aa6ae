"""Flow signatures: duration curve, extremes, indices, timing, variability, period metrics.

Input is the daily table ``(series_id, date, value)``; null values are dropped first, as every
signature counts observed days.  Each family shuffles once on the series key: thresholds, lags
and run marks are windows over that partitioning and the closing ``groupBy`` reuses it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import runs as R
from ..functions import stats as S

KEY = ("series_id",)
# Default exceedance percentages and quantiles.
EXCEEDANCE = (5, 10, 20, 30, 50, 70, 80, 90, 95, 99)
QUANTILES = (0.01, 0.05, 0.1, 0.9, 0.95, 0.99)


def val() -> Column:
    return F.col("value")



def observed(df: DataFrame) -> DataFrame:
    return df.where(val().isNotNull())


def exceeded(p: float) -> Column:
    """Flow exceeded ``p`` percent of the time: a small ``p`` is a high flow."""
    if not 0 <= p <= 100:
        raise ValueError("exceedance must lie in 0..100")
    return S.quantile(val(), round(1 - p / 100, 6))


def fdc_slope(p1: float = 33, p2: float = 66) -> Column:
    a, b = exceeded(p1), exceeded(p2)
    return F.when((a > 0) & (b > 0), (F.ln(a) - F.ln(b)) / (p2 - p1) * 100)


# --- duration curve -----------------------------------------------------------------------


def exceedance_curve(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Descending rank over n + 1, in percent, for every observed day."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc("value"), "date"))
    return observed(df).select(
        *keys, "date", "value", (rank / (F.count("*").over(w) + 1) * 100).alias("exceedance")
    )


def fdc_metrics(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    percentages: Sequence[int] = EXCEEDANCE,
    slope: tuple[float, float] = (33, 66),
) -> DataFrame:
    """Percentile flows, slope, ratio indices and moments in one aggregation."""
    q = exceeded
    return observed(df).groupBy(*keys).agg(
        *[q(p).alias(f"q{p:02d}") for p in percentages],
        fdc_slope(*slope).alias("fdc_slope"),
        S.div_pos(q(5), q(95)).alias("q5_q95_ratio"),
        S.div_pos(q(5), q(50)).alias("q5_q50_ratio"),
        S.div_pos(q(50), q(95)).alias("q50_q95_ratio"),
        S.div_pos(q(25) - q(75), q(50)).alias("iqr_ratio"),
        F.avg(val()).alias("mean_flow"),
        q(50).alias("median_flow"),
        S.cv_pop(val()).alias("cv_flow"),
        S.adjusted_skew(val()).alias("skewness"),
        S.adjusted_kurtosis(val()).alias("kurtosis"),
    )


def flow_regime(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    steep: float = -1.5,
    flat: float = -0.5,
    low_cv: float = 0.5,
    high_cv: float = 1.5,
) -> DataFrame:
    """Regime label from curve slope and coefficient of variation.

    The slope of any falling curve is positive here, so with the default bounds the class is
    "flat"; the bounds are parameters for callers who want another convention.
    """
    base = observed(df).groupBy(*keys).agg(fdc_slope().alias("fdc_slope"), S.cv_pop(val()).alias("coefficient_variation"))
    s, c = F.col("fdc_slope"), F.col("coefficient_variation")
    out = base.select(
        "*",
        F.when(s < steep, "steep").when(s > flat, "flat").otherwise("moderate").alias("slope_class"),
        F.when(c < low_cv, "low").when(c > high_cv, "high").otherwise("moderate").alias("variability_class"),
    )
    sc, vc = F.col("slope_class"), F.col("variability_class")
    regime = (
        F.when((sc == "steep") & (vc == "high"), "flashy")
        .when((sc == "flat") & (vc == "low"), "stable")
        .when(sc == "moderate", "intermediate")
        .otherwise(F.concat_ws("_", vc, sc))
    )
    return out.withColumn("flow_regime", regime)


def regime_classification(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Second regime labelling, with its own bounds, plus the low-flow share."""
    base = observed(df).groupBy(*keys).agg(
        S.cv_pop(val()).alias("coefficient_of_variation"),
        fdc_slope().alias("fdc_slope"),
        S.div_pos(exceeded(95), F.avg(val())).alias("baseflow_ratio_approx"),
    )
    s, c = F.col("fdc_slope"), F.col("coefficient_of_variation")
    label = (
        F.when(s.isNull() | c.isNull(), "unclassified")
        .when((s < -2.0) & (c > 1.0), "flashy")
        .when((s > -0.8) & (c < 0.7), "baseflow_dominated")
        .when(s.between(-2.0, -0.8), "intermediate")
        .otherwise("variable")
    )
    return base.withColumn("regime_classification", label)


# --- extremes -------------------------------------------------------------------------------


def flow_quantiles(df: DataFrame, keys: Sequence[str] = KEY, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Plain quantiles, named after their percentage (``q01_0``)."""
    return observed(df).groupBy(*keys).agg(
        *[S.quantile(val(), p).alias(f"q{p * 100:04.1f}".replace(".", "_")) for p in quantiles]
    )


def threshold_events(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    high_multiplier: float = 2.0,
    low_multiplier: float = 0.2,
) -> DataFrame:
    """Days above ``high·median`` and below ``low·mean``: share, level, event count, durations.

    A run of event days breaks at any date step other than one day.
    """
    whole = Window.partitionBy(*keys)
    base = observed(df).select(
        *keys, "date", "value",
        (S.quantile(val(), 0.5).over(whole) * high_multiplier).alias("hi"),
        (F.avg(val()).over(whole) * low_multiplier).alias("lo"),
    )
    marked = R.mark_runs(base, val() > F.col("hi"), keys, prefix="h")
    marked = R.mark_runs(marked, val() < F.col("lo"), keys, prefix="l")
    marked = marked.select(
        "*", R.run_position(keys, prefix="h").alias("h_pos"), R.run_position(keys, prefix="l").alias("l_pos")
    )

    def family(side: str, p: str, level: str, extreme: Column, extreme_name: str) -> list[Column]:
        n = F.count_if(F.col(f"{p}_flag"))
        events = F.count_if(F.col(f"{p}_first"))
        hit = F.when(F.col(f"{p}_flag"), val())
        return [
            F.max(level).alias(f"{side}_flow_threshold"),
            (n / F.count("*") * 100).alias(f"{side}_flow_frequency"),
            F.avg(hit).alias(f"{side}_flow_mean"),
            extreme.alias(f"{side}_flow_{extreme_name}"),
            events.alias(f"{side}_flow_events"),
            F.coalesce(S.div(n, events), F.lit(0.0)).alias(f"{side}_flow_avg_duration"),
            F.coalesce(F.max(f"{p}_pos"), F.lit(0)).alias(f"{side}_flow_max_duration"),
        ]

    return marked.groupBy(*keys).agg(
        *family("high", "h", "hi", F.max(F.when(F.col("h_flag"), val())), "max"),
        *family("low", "l", "lo", F.min(F.when(F.col("l_flag"), val())), "min"),
    )


def low_flow_indices(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """5 % / 10 % quantiles, their ratios and the variation below the 5 % level."""
    whole = Window.partitionBy(*keys)
    base = observed(df).withColumn("lvl", S.quantile(val(), 0.05).over(whole))
    below = F.when(val() <= F.col("lvl"), val())
    return base.groupBy(*keys).agg(
        F.max("lvl").alias("q95_flow"),
        S.quantile(val(), 0.1).alias("q90_flow"),
        S.div_pos(F.max("lvl"), F.avg(val())).alias("bfi_approx"),
        S.cv_pop(below).alias("low_flow_cv"),
        S.div_pos(F.max("lvl"), S.quantile(val(), 0.5)).alias("q95_ratio"),
    )


def flood_indices(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 300) -> DataFrame:
    """Mean annual maximum over years with more than ``min_days`` days, and rise statistics."""
    yearly = Window.partitionBy(*keys, "year")
    byyear = yearly.orderBy("date")
    base = observed(df).select(
        *keys, "date", "value", F.year("date").alias("year"),
        (val() - F.lag("value").over(R.ordered(keys))).alias("rise"),
    )
    # The yearly maximum is written on one row per qualifying year only.
    base = base.select(
        "*",
        F.when(
            (F.count("*").over(yearly) > min_days) & (F.row_number().over(byyear) == 1), F.max(val()).over(yearly)
        ).alias("annual_max"),
    )
    whole = Window.partitionBy(*keys)
    base = base.withColumn("flood", F.coalesce(F.avg("annual_max").over(whole), F.avg(val()).over(whole)))
    rise = F.max("rise")
    return base.groupBy(*keys).agg(
        S.quantile(val(), 0.95).alias("q05_flow"),
        S.quantile(val(), 0.9).alias("q10_flow"),
        F.max("flood").alias("mean_annual_flood"),
        (F.max("flood") * 2).alias("flood_threshold"),
        (F.count_if(val() > 2 * F.col("flood")) / F.count("*") * 100).alias("flood_frequency"),
        rise.alias("max_daily_rise"),
        F.avg(F.when(F.col("rise") > 0, F.col("rise"))).alias("mean_daily_rise"),
        S.div_pos(rise, F.avg(val())).alias("flashiness_index"),
    )


def extreme_metrics(df: DataFrame, keys: Sequence[str] = KEY, high: float = 2.0, low: float = 0.2) -> DataFrame:
    """Union of quantiles, threshold events, low-flow and flood indices."""
    k = list(keys)
    return (
        flow_quantiles(df, keys)
        .join(threshold_events(df, keys, high, low), k)
        .join(low_flow_indices(df, keys), k)
        .join(flood_indices(df, keys), k)
    )


def extreme_ratios(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    q05, q50, q95 = S.quantile(val(), 0.95), S.quantile(val(), 0.5), S.quantile(val(), 0.05)
    return observed(df).groupBy(*keys).agg(
        S.div_pos(q05, q95).alias("q05_q95_ratio"),
        S.div_pos(q05, q50).alias("q05_q50_ratio"),
        S.div_pos(q50, q95).alias("q50_q95_ratio"),
        S.div_pos(q05 - q95, q50).alias("extreme_range_ratio"),
    )


# --- classic index families -------------------------------------------------------------------


def magnitude_indices(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean, median, spread and the twelve monthly means (``ma03`` = January … ``ma14``)."""
    m = F.month("date")
    return observed(df).groupBy(*keys).agg(
        F.avg(val()).alias("ma01"),
        S.quantile(val(), 0.5).alias("ma02"),
        *[F.avg(F.when(m == i, val())).alias(f"ma{i + 2:02d}") for i in range(1, 13)],
        F.stddev_pop(val()).alias("ma15"),
        S.div_pos(F.stddev_pop(val()), F.avg(val())).alias("ma16"),
    )


def frequency_duration_indices(
    df: DataFrame, keys: Sequence[str] = KEY, high: float = 3.0, low: float = 0.1, legacy: bool = True
) -> DataFrame:
    """Shares, pulse counts and event durations beyond ``high·median`` / ``low·mean``.

    A pulse is a rising transition, so a run that opens the record is not one.  ``legacy``
    measures durations in elapsed days up to the first row outside the event; otherwise they
    are contiguous observed days.
    """
    whole = Window.partitionBy(*keys)
    w = R.ordered(keys)
    base = observed(df).select(
        *keys, "date", "value",
        (val() > S.quantile(val(), 0.5).over(whole) * high).alias("h"),
        (val() < F.avg(val()).over(whole) * low).alias("l"),
    )
    if legacy:
        cols = []
        for s in ("h", "l"):
            _, days = R.elapsed_duration(F.col(s), keys)
            cols.append(days.alias(f"{s}_days"))
        base = base.select("*", *cols)
        dur = {s: (F.avg(f"{s}_days"), F.max(f"{s}_days")) for s in ("h", "l")}
    else:
        for s in ("h", "l"):
            base = R.mark_runs(base, F.col(s), keys, prefix=s + "r")
            base = base.withColumn(s + "_pos", R.run_position(keys, prefix=s + "r"))
        dur = {
            s: (S.div(F.count_if(s), F.count_if(s + "r_first")), F.max(s + "_pos")) for s in ("h", "l")
        }
    base = base.select(
        "*",
        (F.col("h") & ~F.lag("h").over(w)).alias("h_rise"),
        (F.col("l") & ~F.lag("l").over(w)).alias("l_rise"),
    )
    zero = F.lit(0.0)
    return base.groupBy(*keys).agg(
        (F.count_if("h") / F.count("*") * 100).alias("fh01"),
        F.count_if("h_rise").cast("double").alias("fh02"),
        (F.count_if("l") / F.count("*") * 100).alias("fl01"),
        F.count_if("l_rise").cast("double").alias("fl02"),
        F.coalesce(dur["h"][0].cast("double"), zero).alias("dh01"),
        F.coalesce(dur["h"][1].cast("double"), zero).alias("dh02"),
        F.coalesce(dur["l"][0].cast("double"), zero).alias("dl01"),
        F.coalesce(dur["l"][1].cast("double"), zero).alias("dl02"),
    )


def flow_duration_timing(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Frequency and elapsed-day durations beyond 2·median / 0.2·mean."""
    f = frequency_duration_indices(df, keys, high=2.0, low=0.2)
    return f.select(
        *keys,
        F.col("fh01").alias("high_flow_freq"), F.col("fl01").alias("low_flow_freq"),
        F.col("dh01").alias("high_flow_avg_duration"), F.col("dl01").alias("low_flow_avg_duration"),
        F.col("dh02").alias("high_flow_max_duration"), F.col("dl02").alias("low_flow_max_duration"),
    )


def _annual_extreme_days(df: DataFrame, keys: Sequence[str], min_days: int) -> DataFrame:
    """Day-of-year of each year's first maximum and first minimum."""
    d = F.datediff("date", F.lit("1970-01-01").cast("date"))
    return (
        observed(df)
        .groupBy(*keys, F.year("date").alias("year"))
        .agg(
            F.count("*").alias("n"),
            F.dayofyear(F.max_by("date", F.struct(val(), -d))).alias("max_doy"),
            F.dayofyear(F.min_by("date", F.struct(val(), d))).alias("min_doy"),
        )
        .where(F.col("n") >= min_days)
    )


def timing_indices(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 301) -> DataFrame:
    return _annual_extreme_days(df, keys, min_days).groupBy(*keys).agg(
        F.avg("max_doy").alias("ta01"), F.avg("min_doy").alias("ta02")
    )


def extreme_timing(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 300) -> DataFrame:
    return _annual_extreme_days(df, keys, min_days).groupBy(*keys).agg(
        F.avg("max_doy").alias("max_timing_mean"), F.stddev_pop("max_doy").alias("max_timing_std"),
        F.avg("min_doy").alias("min_timing_mean"), F.stddev_pop("min_doy").alias("min_timing_std"),
    )


def rate_of_change_indices(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean and median of rises and falls, and how often the change itself changes."""
    w = R.ordered(keys)
    d = F.col("d")
    base = observed(df).select(*keys, "date", "value", (val() - F.lag("value").over(w)).alias("d"))
    base = base.withColumn("pd", F.lag("d").over(w))
    up, down = F.when(d > 0, d), F.when(d < 0, -d)
    zero = F.lit(0.0)
    return base.groupBy(*keys).agg(
        F.coalesce(F.avg(up), zero).alias("ra01"),
        F.coalesce(S.quantile(up, 0.5), zero).alias("ra02"),
        F.coalesce(F.avg(down), zero).alias("ra03"),
        F.coalesce(S.quantile(down, 0.5), zero).alias("ra04"),
        F.count_if(d.isNotNull() & (F.col("pd").isNull() | (d != F.col("pd")))).cast("double").alias("ra05"),
    )


# --- timing -----------------------------------------------------------------------------------


def half_flow_dates(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 300) -> DataFrame:
    """Hydro-day on which each year's running total reaches half of the year's total."""
    y = observed(df).withColumn("hydro_year", C.hydro_year(F.col("date")))
    k = [*keys, "hydro_year"]
    whole = Window.partitionBy(*k)
    y = y.select(
        *k, "date",
        F.sum(val()).over(R.upto(k)).alias("run"), F.sum(val()).over(whole).alias("total"), F.count("*").over(whole).alias("n"),
    )
    return (
        y.where((F.col("n") >= min_days) & (F.col("run") >= F.col("total") / 2))
        .groupBy(*k)
        .agg(C.hydro_day(F.min("date")).alias("hfd"))
    )


def half_flow_date(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 300) -> DataFrame:
    return half_flow_dates(df, keys, min_days).groupBy(*keys).agg(
        F.avg("hfd").alias("hfd_mean"), F.stddev_pop("hfd").alias("hfd_std")
    )


def seasonal_flows(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean, spread and share of the overall mean per season."""
    s = C.season(F.col("date"))
    cols = []
    for name in C.SEASONS:
        x = F.when(s == name, val())
        cols += [
            F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std"),
            S.cv_pop(x).alias(f"{name}_cv"), S.div(F.avg(x), F.avg(val())).alias(f"{name}_ratio"),
        ]
    return observed(df).groupBy(*keys).agg(*cols)


def timing_metrics(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Union of half-flow date, seasonal flows, extreme timing and duration metrics."""
    k = list(keys)
    return (
        seasonal_flows(df, keys)
        .join(half_flow_date(df, keys), k, "left")
        .join(extreme_timing(df, keys), k, "left")
        .join(flow_duration_timing(df, keys), k, "left")
    )


def regime_stability(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 300) -> DataFrame:
    """Interannual variation of each season's mean over years with enough days."""
    k = [*keys, "year"]
    s = C.season(F.col("date"))
    per = (
        observed(df)
        .groupBy(*keys, F.year("date").alias("year"))
        .agg(F.count("*").alias("n"), *[F.avg(F.when(s == x, val())).alias(x) for x in C.SEASONS])
        .where(F.col("n") >= min_days)
    )
    return per.groupBy(*keys).agg(
        *[F.when(F.count(x) > 1, S.cv_pop(x)).alias(f"{x}_interannual_cv") for x in C.SEASONS]
    )


# --- variability ------------------------------------------------------------------------------


def basic_statistics(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return observed(df).groupBy(*keys).agg(
        F.avg(val()).alias("mean"), S.quantile(val(), 0.5).alias("median"), F.stddev_pop(val()).alias("std"),
        F.var_pop(val()).alias("variance"), S.cv_pop(val()).alias("cv"), S.adjusted_skew(val()).alias("skewness"),
        S.adjusted_kurtosis(val()).alias("kurtosis"), F.min(val()).alias("min"), F.max(val()).alias("max"),
        (F.max(val()) - F.min(val())).alias("range"), (S.quantile(val(), 0.75) - S.quantile(val(), 0.25)).alias("iqr"),
    )


def temporal_variability(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Daily change, seven-row rolling mean and monthly-mean variation."""
    w = R.ordered(keys)
    week = w.rowsBetween(-6, 0)
    k2 = [*keys, "ym"]
    month = Window.partitionBy(*k2)
    base = observed(df).select(
        *keys, "date", "value",
        F.trunc("date", "month").alias("ym"),
        (val() - F.lag("value").over(w)).alias("d"),
        F.when(F.count("*").over(week) == 7, F.avg(val()).over(week)).alias("wk"),
    )
    base = base.select(
        "*",
        (F.col("wk") - F.lag("wk").over(w)).alias("wd"),
        F.when(F.row_number().over(month.orderBy("date")) == 1, F.avg(val()).over(month)).alias("mm"),
    )
    n = F.count("*")
    return base.groupBy(*keys).agg(
        F.avg("d").alias("daily_change_mean"),
        F.stddev_pop("d").alias("daily_change_std"),
        S.div(F.stddev_pop("d"), F.abs(F.avg("d"))).alias("daily_change_cv"),
        F.when(n > 7, F.stddev_pop("wd")).alias("weekly_change_std"),
        F.when(n > 7, S.cv_pop("wk")).alias("weekly_cv"),
        F.when((n > 30) & (F.count("mm") > 1), S.cv_pop("mm")).alias("monthly_cv"),
    )


def autocorrelation(df: DataFrame, keys: Sequence[str] = KEY, lags: Sequence[int] = (1, 7, 30, 365)) -> DataFrame:
    """Pearson correlation with earlier rows (row lags, not calendar lags)."""
    w = R.ordered(keys)
    base = observed(df).select(*keys, "value", *[F.lag("value", k).over(w).alias(f"l{k}") for k in lags])
    first = lags[0]
    out = [S.corr("value", f"l{k}").alias(f"lag{k}_autocorr") for k in lags]
    out[0] = F.coalesce(S.corr("value", f"l{first}"), F.lit(0.0)).alias(f"lag{first}_autocorr")
    return base.groupBy(*keys).agg(*out)


def flashiness(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Sum of absolute day-to-day changes over the flow total without the first day."""
    w = R.ordered(keys)
    d = F.col("d")
    base = observed(df).select(*keys, "date", "value", F.abs(val() - F.lag("value").over(w)).alias("d"))
    total = F.sum(F.when(d.isNotNull(), val()))
    return base.groupBy(*keys).agg(
        S.div_pos(F.sum(d), total).alias("flashiness_index"),
        F.avg(d).alias("mean_abs_daily_change"),
        F.max(d).alias("max_abs_daily_change"),
        F.when(F.avg(d) > 0, S.cv_pop(d)).alias("change_variability"),
    )


def seasonal_variability(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Spread of the monthly means and the mean within-month variation."""
    per = observed(df).groupBy(*keys, F.month("date").alias("month")).agg(
        F.avg(val()).alias("m"), S.cv_samp(val()).alias("cv")
    )
    return per.groupBy(*keys).agg(
        S.cv_pop("m").alias("seasonal_cv"),
        (F.max("m") - F.min("m")).alias("seasonal_range"),
        F.max("m").alias("max_monthly_mean"),
        F.min("m").alias("min_monthly_mean"),
        S.div_pos(F.max("m"), F.min("m")).alias("seasonal_ratio"),
        F.avg("cv").alias("avg_within_month_cv"),
    )


def interannual_variability(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Variation of annual mean, maximum and minimum; slope of the means on their position."""
    per = observed(df).groupBy(*keys, F.year("date").alias("year")).agg(
        F.avg(val()).alias("m"), F.max(val()).alias("hi"), F.min(val()).alias("lo")
    )
    per = per.withColumn("pos", F.row_number().over(R.ordered(keys, "year")) - 1)
    return (
        per.groupBy(*keys)
        .agg(
            F.count("*").alias("n_years"),
            S.cv_pop("m").alias("interannual_cv"),
            S.div(F.max("m"), F.min("m")).alias("max_annual_ratio"),
            S.cv_pop("hi").alias("annual_max_cv"),
            S.cv_pop("lo").alias("annual_min_cv"),
            F.when(F.count("*") >= 3, F.regr_slope("m", "pos")).alias("annual_mean_trend"),
        )
        .where("n_years >= 2")
        .drop("n_years")
    )


def variability_metrics(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    k = list(keys)
    out = basic_statistics(df, keys)
    for part in (temporal_variability, autocorrelation, flashiness, seasonal_variability, interannual_variability):
        out = out.join(part(df, keys), k, "left")
    return out


def stability_index(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One minus a weighted sum of variation, lag-1 decorrelation and flashiness, in 0..1."""
    k = list(keys)
    base = (
        observed(df).groupBy(*keys).agg(S.cv_pop(val()).alias("cv"))
        .join(autocorrelation(df, keys, (1,)), k)
        .join(flashiness(df, keys).select(*keys, "flashiness_index"), k)
    )
    out = base.select(
        *keys,
        F.least(F.col("cv") / 2.0, F.lit(1.0)).alias("cv_component"),
        F.greatest(F.lit(0.0), F.col("lag1_autocorr")).alias("autocorr_component"),
        F.coalesce(F.least(F.col("flashiness_index") / 0.5, F.lit(1.0)), F.lit(0.5)).alias("flashiness_component"),
    )
    idx = 1.0 - (
        F.col("cv_component") * 0.4 + (1 - F.col("autocorr_component")) * 0.3 + F.col("flashiness_component") * 0.3
    )
    return out.withColumn("stability_index", F.greatest(F.lit(0.0), F.least(F.lit(1.0), idx)))


def comprehensive_indices(df: DataFrame, keys: Sequence[str] = KEY, detailed: bool = True) -> DataFrame:
    """Prefixed union of the index families (one wide row per series)."""
    k = list(keys)
    fd = frequency_duration_indices(df, keys)
    parts = [
        ("magnitude_", magnitude_indices(df, keys)),
        ("frequency_", fd.select(*keys, "fh01", "fh02", "fl01", "fl02")),
        ("duration_", fd.select(*keys, "dh01", "dh02", "dl01", "dl02")),
        ("timing_", timing_indices(df, keys)),
        ("rate_", rate_of_change_indices(df, keys)),
    ]
    if detailed:
        parts += [
            ("fdc_", fdc_metrics(df, keys)),
            ("extreme_", extreme_metrics(df, keys)),
            ("timing_detailed_", timing_metrics(df, keys)),
            ("variability_", variability_metrics(df, keys)),
        ]
    out = None
    for prefix, part in parts:
        named = part.select(*keys, *[F.col(c).alias(prefix + c) for c in part.columns if c not in k])
        out = named if out is None else out.join(named, k, "left")
    return out


# --- period metrics -----------------------------------------------------------------------------

PERIOD_METRICS = (
    "mean_discharge", "median_discharge", "std_discharge", "total_discharge", "cv_discharge", "fdc_slope",
    "q05", "q50", "q95", "high_flow_frequency", "high_flow_avg_duration", "low_flow_frequency",
    "low_flow_avg_duration", "mean_half_flow_date",
)


def period_metrics(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    kind: str = "hydrological",
    start_month: int = C.HYDRO_START,
    min_fraction: float = 0.7,
    min_days: int = 300,
) -> DataFrame:
    """Signature row per (series, period); all null where too few of the period's rows hold data.

    ``min_days`` is the completeness bound of the half-flow date.  Rows with a null value count
    as expected days, so pass a dense calendar when absent days should count too.
    """
    k = [*keys, "period"]
    whole = Window.partitionBy(*k)
    base = df.withColumn("period", C.period(F.col("date"), kind, start_month))
    base = base.select(
        *k, "date", "value",
        (F.count("value").over(whole) / F.count("*").over(whole)).alias("frac"),
        (S.quantile(val(), 0.5).over(whole) * 2.0).alias("hi"),
        (F.avg(val()).over(whole) * 0.2).alias("lo"),
        F.sum(val()).over(R.upto(k)).alias("run"),
        F.sum(val()).over(whole).alias("total"),
    )
    seen = base.where(val().isNotNull())
    seen = R.mark_runs(seen, val() > F.col("hi"), k, prefix="h")
    seen = R.mark_runs(seen, val() < F.col("lo"), k, prefix="l")
    nh, eh = F.count_if("h_flag"), F.count_if("h_first")
    nl, el = F.count_if("l_flag"), F.count_if("l_first")
    zero = F.lit(0.0)
    half = F.min(F.when(F.col("run") >= F.col("total") / 2, F.col("date")))
    metrics = {
        "mean_discharge": F.avg(val()), "median_discharge": S.quantile(val(), 0.5), "std_discharge": F.stddev_pop(val()),
        "total_discharge": F.sum(val()), "cv_discharge": F.when(F.avg(val()) > 0, S.cv_pop(val())), "fdc_slope": fdc_slope(),
        "q05": exceeded(5), "q50": exceeded(50), "q95": exceeded(95),
        "high_flow_frequency": nh / F.count("*") * 100,
        "high_flow_avg_duration": F.coalesce(S.div(nh, eh), zero),
        "low_flow_frequency": nl / F.count("*") * 100,
        "low_flow_avg_duration": F.coalesce(S.div(nl, el), zero),
        "mean_half_flow_date": F.when(F.count("*") >= min_days, C.hydro_day(half).cast("double")),
    }
    ok = F.min("frac") >= min_fraction
    return seen.groupBy(*k).agg(*[F.when(ok, m).alias(n) for n, m in metrics.items()])


def aggregate_periods(
    periods: DataFrame, keys: Sequence[str] = KEY, how: str = "mean", min_periods: int = 3
) -> DataFrame:
    """Mean, median or standard deviation over periods, each metric with its own minimum count."""
    fold = {
        "mean": F.avg, "median": lambda c: S.quantile(c, 0.5), "std": F.stddev_pop,
    }
    if how not in fold:
        raise ValueError(f"invalid aggregation: {how}")
    cols = [c for c in periods.columns if c not in (*keys, "period")]
    enough = F.count("*") >= min_periods
    out = periods.groupBy(*keys).agg(
        *[F.when(enough & (F.count(c) >= min_periods), fold[how](c)).alias(c) for c in cols],
        F.count("mean_discharge").alias("n_valid_periods"),
        F.stddev_pop("mean_discharge").alias("mean_discharge_std"),
    )
    return out.withColumn("mean_discharge_cv", S.div_pos(F.col("mean_discharge_std"), F.col("mean_discharge")))


def series_signatures(df: DataFrame, keys: Sequence[str] = KEY, **kw) -> DataFrame:
    """Period metrics averaged per series; the fan-out over series is the group-by itself."""
    agg = {k: kw.pop(k) for k in ("how", "min_periods") if k in kw}
    return aggregate_periods(period_metrics(df, keys, **kw), keys, **agg)


def runoff_ratio(
    flow: DataFrame, precip: DataFrame, keys: Sequence[str] = KEY, min_periods: int = 3,
    kind: str = "hydrological", start_month: int = C.HYDRO_START,
) -> DataFrame:
    """Mean of annual flow over annual input for the years both hold, days not paired."""
    k = [*keys, "period"]
    per = C.period(F.col("date"), kind, start_month).alias("period")
    q = flow.groupBy(*keys, per).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("q"))
    p = precip.groupBy(*keys, per).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("p"))
    ratio = S.div_pos(F.col("q"), F.col("p"))
    return q.join(p, k).groupBy(*keys).agg(
        F.when(F.count(ratio) >= min_periods, F.avg(ratio)).alias("runoff_ratio")
    )


def winter_ratio(
    df: DataFrame, keys: Sequence[str] = KEY, min_fraction: float = 0.7, min_seasons: int = 5
) -> DataFrame:
    """Mean January–March flow over mean flow, where enough winters are observed."""
    y = F.year("date")
    m = F.month("date")
    per = (
        df.groupBy(*keys, y.alias("year"))
        .agg(
            F.count(F.when(m <= 3, val())).alias("nw"), F.count_if(m <= 3).alias("rw"), F.sum(F.when(m <= 3, val())).alias("sw"),
            F.count(val()).alias("n"), F.sum(val()).alias("s"),
        )
        .withColumn("ok", S.div(F.col("nw"), F.col("rw")) >= min_fraction)
    )
    seasons = F.count_if("ok")
    return per.groupBy(*keys).agg(
        seasons.alias("n_valid_winter_seasons"),
        S.div(F.sum("nw"), F.sum("rw")).alias("winter_coverage"),
        F.when(
            seasons >= min_seasons,
            S.div(S.div(F.sum("sw"), F.sum("nw")), S.div(F.sum("s"), F.sum("n"))),
        ).alias("winter_flow_ratio"),
    )


def metric_summary(wide: DataFrame, metrics: Sequence[str], ids: Sequence[str] = KEY) -> DataFrame:
    """Network summary per metric: n, mean, median, std, min, max.

    Medians go through the distributed rank helper, as the number of series is not bounded.
    """
    from ..functions.quantiles import exact_quantiles

    long = S.unpivot(wide, ids, metrics).where(val().isNotNull())
    stats = long.groupBy("metric").agg(
        F.count(val()).alias("n"), F.avg(val()).alias("mean"), F.stddev_samp(val()).alias("std"),
        F.min(val()).alias("min"), F.max(val()).alias("max"),
    )
    med = exact_quantiles(long, ["metric"], "value", {"median": 0.5})
    return stats.join(med, "metric")


def slope_agreement(df: DataFrame, keys: Sequence[str] = KEY, min_fraction: float = 0.7) -> DataFrame:
    """Whole-record against mean-of-annual curve slope over all series, as one row."""
    from ..functions.quantiles import exact_quantiles, spearman

    k = list(keys)
    whole = observed(df).groupBy(*keys).agg(fdc_slope().alias("whole_slope"))
    annual = series_signatures(df, keys, min_fraction=min_fraction, min_periods=1).select(
        *keys, F.col("fdc_slope").alias("annual_slope")
    )
    both = whole.join(annual, k).where("whole_slope IS NOT NULL AND annual_slope IS NOT NULL")
    both = both.withColumn(
        "rel", S.div(F.col("annual_slope") - F.col("whole_slope"), F.col("whole_slope"))
    ).withColumn("all", F.lit(0))
    base = both.groupBy("all").agg(
        F.count("*").alias("n"),
        F.avg((F.signum("whole_slope") == F.signum("annual_slope")).cast("double")).alias("sign_agreement"),
    )
    # Three single rows side by side.
    rho = spearman(both, ["all"], "whole_slope", "annual_slope").select("rho")
    median = exact_quantiles(both, ["all"], "rel", {"median_rel_diff": 0.5}).select("median_rel_diff")
    return base.drop("all").join(F.broadcast(rho)).join(F.broadcast(median))


def seasonal_cycle(df: DataFrame, keys: Sequence[str] = KEY, max_value: float = 50.0) -> DataFrame:
    """Median per calendar day without 29 February, scaled to 0..1 per series.

    Only series with all 365 days and a peak below ``max_value`` are kept.
    """
    w = Window.partitionBy(*keys)
    cyc = (
        observed(df)
        .where(~((F.month("date") == 2) & (F.dayofmonth("date") == 29)))
        .groupBy(*keys, F.month("date").alias("month"), F.dayofmonth("date").alias("day"))
        .agg(S.quantile(val(), 0.5).alias("med"))
    )
    lo, hi = F.min("med").over(w), F.max("med").over(w)
    return (
        cyc.select("*", F.count("*").over(w).alias("_n"), hi.alias("_hi"), S.div(F.col("med") - lo, hi - lo).alias("scaled"))
        .where((F.col("_n") == 365) & (F.col("_hi") < max_value))
        .drop("_n", "_hi")
    )


# The published table's columns, in its order.
PAPER_METRICS = (
    "q_mean", "runoff_ratio", "q_cv", "fdc_slope", "flashiness_index", "q05", "q95", "high_flow_freq", "high_flow_dur",
    "baseflow_index", "low_flow_freq", "low_flow_dur", "half_flow_date", "winter_flow_ratio", "aridity_index", "evaporative_index",
)


def paper_table(
    forcing: DataFrame, areas: DataFrame, window: tuple[str, str], keys: Sequence[str] = KEY, min_years: int = 5,
    max_area: float = 50_000.0, samples: int = 1000,
) -> DataFrame:
    """The sixteen headline signatures per series with their screens, ordered by id.

    ``forcing`` is ``(keys, date, value, p, pet)`` on a dense calendar, ``areas`` ``(keys, area_km2)``.
    A tiny catchment with a huge depth is anomalous; a runoff ratio above one fails the water
    balance screen.
    """
    from . import balance as WB
    from . import baseflow as BF

    k = list(keys)
    days = forcing.where(F.col("date").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
    days = days.join(areas.where(F.col("area_km2") < max_area).select(*k), k, "left_semi")
    q = days.select(*k, "date", "value")
    per = period_metrics(q, keys)
    ok = per.where("mean_discharge IS NOT NULL").select(*k, "period")
    yearly = q.where(val().isNotNull()).withColumn("period", C.hydro_year(F.col("date"))).join(ok, [*k, "period"], "left_semi")
    bfi = BF.baseflow_index(yearly, [*k, "period"], samples=samples).groupBy(*k).agg(
        F.when(F.count("bfi") >= min_years, F.avg("bfi")).alias("baseflow_index")
    )
    m = aggregate_periods(per, keys, min_periods=min_years).where("mean_discharge IS NOT NULL")
    out = (
        m.join(bfi, k, "left").join(flashiness(q, keys).select(*k, "flashiness_index"), k, "left")
        .join(winter_ratio(q, keys, min_seasons=min_years), k, "left").join(WB.paired_ratios(days, keys, min_years=min_years).drop("n_valid_years"), k, "left")
        .join(areas, k)
    )
    renamed = {
        "q_mean": "mean_discharge", "q_cv": "cv_discharge", "high_flow_freq": "high_flow_frequency",
        "high_flow_dur": "high_flow_avg_duration", "low_flow_freq": "low_flow_frequency", "low_flow_dur": "low_flow_avg_duration",
        "half_flow_date": "mean_half_flow_date",
    }
    a, mean = F.col("area_km2"), F.col("mean_discharge")
    return out.select(
        *k, a, ((a < 50.0) & (mean > 20.0)).alias("is_anomalous"), F.coalesce(F.col("runoff_ratio") > 1.0, F.lit(False)).alias("water_balance_screen"),
        *[F.col(renamed.get(n, n)).alias(n) for n in PAPER_METRICS], "winter_coverage", F.col("n_valid_periods").alias("n_valid_years"),
    ).orderBy(F.col(k[0]).try_cast("bigint"), k[0])
