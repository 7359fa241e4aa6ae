"""Quality control of daily series: constant runs, spikes, variance, climatology, year flags.

Year-level results carry ``(keys, hydro_year, …)``.  Flags are arrays of string codes in a fixed
order.  Every detector is windows plus one group-by over the series key, so the daily table is
shuffled once per detector and year tables are joined at year size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import distributions as D
from ..functions import runs as R
from ..functions import stats as S

KEY = ("series_id",)

# Months of the ice season and the severity of each flag.
ICE_MONTHS = (11, 12, 1, 2, 3, 4)
SEVERITY = {
    "low_clim_correlation": "minor",
    "very_low_clim_correlation": "major",
    "high_clim_nrmse": "minor",
    "low_amplitude": "minor",
    "high_amplitude": "minor",
    "no_seasonal_signal": "critical",
    "no_precip_response": "minor",
    "very_low_pq_correlation": "minor",
    "low_pq_correlation": "minor",
    "low_flashiness": "minor",
    "no_effective_water_response": "minor",
    "very_low_effective_water_correlation": "minor",
    "low_effective_water_correlation": "minor",
    "constant_value": "major",
    "implausible_spike": "minor",
    "abnormal_low_variance": "minor",
    "abnormal_high_variance": "minor",
    "low_completeness": "major",
    "very_low_completeness": "critical",
    "negative_values": "critical",
    "zero_flow_dominant": "minor",
}


def val() -> Column:
    return F.col("value")



def flag_array(*flags: Column) -> Column:
    """Array of the non-null codes, in argument order."""
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def severity_counts(flags: Column) -> dict[str, Column]:
    """Number of critical, major and minor codes; unknown codes count as minor."""
    known = {s: [f for f, sev in SEVERITY.items() if sev == s] for s in ("critical", "major")}
    among = lambda codes: F.size(F.filter(flags, lambda f: f.isin(*codes)))
    counts = {s: among(codes) for s, codes in known.items()}
    counts["minor"] = F.size(flags) - counts["critical"] - counts["major"]
    return counts


def observed_years(df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START) -> DataFrame:
    """Observed days with their hydrological year."""
    return df.where(val().isNotNull()).withColumn("hydro_year", C.hydro_year(F.col("date"), start_month))


# --- runs and spikes --------------------------------------------------------------------------


def constant_runs(
    df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 30, tolerance: float = 1e-6,
    ice_months: Sequence[int] = ICE_MONTHS,
) -> DataFrame:
    """Runs of observed values that repeat the previous one, with their share of ice-season days.

    Runs are counted in observed rows and may span date gaps; slow drift within the tolerance
    stays in one run because each value is compared with the one before it.
    """
    w = R.ordered(keys)
    same = F.abs(val() - F.lag("value").over(w)) <= tolerance
    base = df.where(val().isNotNull()).withColumn("breaks", F.when(same, 0).otherwise(1))
    base = base.withColumn("grp", F.sum("breaks").over(R.upto(keys))).withColumn("alone", (F.col("breaks") == 1) & (F.coalesce(F.lead("breaks").over(w), F.lit(1)) == 1))
    out = (
        base.where("NOT alone").groupBy(*keys, "grp")  # most rows are runs of one, which need no group
        .agg(
            F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n_days"),
            F.min_by("value", "date").alias("run_value"),
        )
        .where((F.col("n_days") >= min_days) & (F.col("n_days") >= 2))
        .drop("grp")
    )
    days = F.sequence("start", "end")
    ice = F.size(F.filter(days, lambda d: F.month(d).isin(*ice_months)))
    return out.withColumn("ice_fraction", ice / (F.datediff("end", "start") + 1))


def _median_of_sorted(a: Column) -> Column:
    n = F.size(a)
    return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, (F.floor(n / 2) + 1).cast("int"))) / 2


def spike_scores(
    df: DataFrame, keys: Sequence[str] = KEY, window_days: int = 30, min_periods: int = 10
) -> DataFrame:
    """Distance from the centred rolling median in scaled median absolute deviations.

    The frame counts observed rows: half the window before, the rest from the row on.  It is read
    with lag and lead, which stay cheap offset frames, and medians come from the sorted array.
    """
    w = R.ordered(keys)
    half = window_days // 2
    around = [F.lag("value", i).over(w) for i in range(half, 0, -1)] + [val()]
    around += [F.lead("value", i).over(w) for i in range(1, window_days - half)]
    def let(value: Column, body) -> Column:
        """Bind a value to a lambda variable, so it is computed once however often it is used."""
        return F.transform(F.array(value), body)[0]

    def score(a: Column) -> Column:
        dev = lambda m: let(F.sort_array(F.transform(a, lambda x: F.abs(x - m))), _median_of_sorted)
        return let(
            _median_of_sorted(a), lambda m: F.struct(F.size(a).alias("k"), m.alias("m"), (dev(m) * 1.4826).alias("s"))
        )

    base = df.where(val().isNotNull()).select(
        *keys, "date", "value", F.array_compact(F.array(*around)).alias("_a"), F.count("*").over(Window.partitionBy(*keys)).alias("_n")
    )
    base = base.where(F.col("_n") >= window_days).withColumn("_s", let(F.sort_array("_a"), score))
    return base.where((F.col("_s.k") >= min_periods) & (F.col("_s.s") > 0)).select(
        *keys, "date", "value", F.col("_s.m").alias("rolling_median"), (F.abs(val() - F.col("_s.m")) / F.col("_s.s")).alias("n_sigma")
    )


def spikes(df: DataFrame, keys: Sequence[str] = KEY, sigma: float = 8.0, window_days: int = 30) -> DataFrame:
    return spike_scores(df, keys, window_days).where(F.col("n_sigma") > sigma)


def spike_sensitivity(df: DataFrame, keys: Sequence[str] = KEY, sigmas: Sequence[float] = (5.0, 8.0)) -> DataFrame:
    """Number and share of series with at least one spike at each level, scored once."""
    per = spike_scores(df, keys).groupBy(*keys).agg(F.max("n_sigma").alias("peak"))
    total = df.where(val().isNotNull()).select(*keys).distinct()
    joined = total.join(per, list(keys), "left")
    levels = F.explode(F.array(*[F.lit(float(s)) for s in sigmas]))
    return (
        joined.select("*", levels.alias("sigma"))
        .groupBy("sigma")
        .agg(
            F.count("*").alias("n_series"),
            F.count_if(F.col("peak") > F.col("sigma")).alias("n_with_spike"),
        )
        .withColumn("pct", F.col("n_with_spike") / F.col("n_series") * 100)
    )


# --- yearly variance and completeness -----------------------------------------------------------


def annual_variance(
    df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START, alpha: float = 0.05
) -> DataFrame:
    """Sample variance of each year against all other days of the series, with a two-sided F test.

    The variance of "all other days" follows from the series moments by the pairwise-update
    identity, so no day is visited once per year.
    """
    w = Window.partitionBy(*keys)
    y = observed_years(df, keys, start_month).groupBy(*keys, "hydro_year").agg(
        F.count("*").alias("n"), F.avg(val()).alias("m"), (F.var_pop(val()) * F.count("*")).alias("ss")
    )
    n, m, ss = F.col("n"), F.col("m"), F.col("ss")
    y = y.select("*", F.sum(n).over(w).alias("tn"), (F.sum(n * m).over(w) / F.sum(n).over(w)).alias("tm"))
    y = y.withColumn("tss", F.sum(ss + n * (m - F.col("tm")) ** 2).over(w)).withColumn("rn", F.col("tn") - n)
    y = y.withColumn("rm", S.div(F.col("tn") * F.col("tm") - n * m, F.col("rn")))
    rest = F.col("tss") - ss - n * F.col("rn") / F.col("tn") * (m - F.col("rm")) ** 2
    enough = (n >= 30) & (F.col("rn") >= 365)
    y = y.select(
        *keys, "hydro_year", "n", "rn",
        F.when(enough, S.div(ss, n - 1)).alias("year_variance"),
        F.when(enough, S.div(F.greatest(rest, F.lit(0.0)), F.col("rn") - 1)).alias("longterm_variance"),
    )
    yv, lv = F.col("year_variance"), F.col("longterm_variance")
    usable = (yv > 0) & (lv > 0)
    y = y.withColumn("f_statistic", F.when(usable, S.div(yv, lv)))
    y = y.withColumn("p_value", D.f_p2("f_statistic", (n - 1).cast("double"), (F.col("rn") - 1).cast("double")))
    y = y.withColumn("p_value", F.when(F.col("f_statistic").isNotNull(), F.col("p_value")))
    f, p = F.col("f_statistic"), F.col("p_value")
    false = F.lit(False)
    return y.select(
        *keys, "hydro_year", "year_variance", "longterm_variance", "f_statistic", "p_value",
        F.when(usable, f).when((lv > 0) & (yv == 0), F.lit(0.0)).alias("variance_ratio"),
        F.coalesce(F.when(usable, (f < 1) & (p < alpha)).otherwise((yv == 0) & (lv > 0)), false).alias("significant_low"),
        F.coalesce((f > 1) & (p < alpha), false).alias("significant_high"),
    )


def data_quality(df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START) -> DataFrame:
    """Completeness, negatives and zeros per year with their flags."""
    y = observed_years(df, keys, start_month).groupBy(*keys, "hydro_year").agg(
        F.count("*").alias("n_days"), F.count_if(val() < 0).alias("n_negative_values"), F.count_if(val() == 0).alias("n_zero")
    )
    y = y.select(
        *keys, "hydro_year", "n_days",
        (F.col("n_days") / C.hydro_length(F.col("hydro_year"), start_month)).alias("completeness"),
        "n_negative_values", (F.col("n_zero") / F.col("n_days")).alias("zero_flow_fraction"),
    )
    c = F.col("completeness")
    return y.withColumn(
        "flags",
        flag_array(
            F.when(c < 0.5, "very_low_completeness").when(c < 0.8, "low_completeness"),
            F.when(F.col("n_negative_values") > 0, "negative_values"),
            F.when(F.col("zero_flow_fraction") > 0.5, "zero_flow_dominant"),
        ),
    )


def _run_years(runs: DataFrame, start_month: int) -> DataFrame:
    """Spread runs over the hydrological years they touch, with the overlap in days."""
    lo, hi = C.hydro_year(F.col("start"), start_month), C.hydro_year(F.col("end"), start_month)
    y = F.col("hydro_year")
    return runs.select("*", F.explode(F.sequence(lo, hi)).alias("hydro_year")).withColumn(
        "overlap_days",
        F.datediff(F.least("end", C.hydro_end(y, start_month)), F.greatest("start", C.hydro_start(y, start_month))) + 1,
    )


def anomaly_metrics(
    df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START, sigma: float = 8.0,
    min_constant: int = 30, with_variance: bool = True,
) -> DataFrame:
    """Per-year evidence: constant days, spikes, variance ratio, completeness, negatives, zeros."""
    k = [*keys, "hydro_year"]
    base = data_quality(df, keys, start_month).drop("flags")
    runs = _run_years(constant_runs(df, keys, min_constant), start_month).groupBy(*k).agg(
        F.sum("overlap_days").alias("constant_days")
    )
    hits = spikes(df, keys, sigma).groupBy(*keys, C.hydro_year(F.col("date"), start_month).alias("hydro_year")).agg(
        F.count("*").alias("n_spikes")
    )
    out = base.join(runs, k, "left").join(hits, k, "left")
    if with_variance:
        out = out.join(annual_variance(df, keys, start_month).select(
            *k, "variance_ratio", F.col("p_value").alias("variance_p_value"),
            F.col("significant_low").alias("variance_significant_low"),
            F.col("significant_high").alias("variance_significant_high")), k, "left")
    return out.fillna(0, ["constant_days", "n_spikes"]).withColumn(
        "constant_fraction", F.col("constant_days") / C.hydro_length(F.col("hydro_year"), start_month)
    )


def anomaly_flags(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    start_month: int = C.HYDRO_START,
    constant_min_days: int = 30,
    sigma: float = 8.0,
    variance_alpha: float = 0.01,
    check_variance: bool = False,
    ice_months: Sequence[int] = ICE_MONTHS,
    ice_run_fraction: float = 0.8,
) -> DataFrame:
    """Flags per year from constant runs outside the ice season, spikes, variance and data quality."""
    k = [*keys, "hydro_year"]
    quality = data_quality(df, keys, start_month).select(*k, F.col("flags").alias("q"))
    runs = constant_runs(df, keys, constant_min_days, ice_months=ice_months)
    const = (
        _run_years(runs.where(F.col("ice_fraction") < ice_run_fraction), start_month)
        .groupBy(*k).agg(F.lit("constant_value").alias("c"))
    )
    hit = (
        spikes(df, keys, sigma)
        .groupBy(*keys, C.hydro_year(F.col("date"), start_month).alias("hydro_year"))
        .agg(F.lit("implausible_spike").alias("s"))
    )
    out = quality.join(const, k, "left").join(hit, k, "left")
    parts = [F.col("c"), F.col("s")]
    if check_variance:
        var = annual_variance(df, keys, start_month, variance_alpha).select(
            *k, F.when(F.col("significant_low"), "abnormal_low_variance")
            .when(F.col("significant_high"), "abnormal_high_variance").alias("v"))
        out = out.join(var, k, "left")
        parts.append(F.col("v"))
    return out.select(*k, F.concat(flag_array(*parts), F.col("q")).alias("flags"))


# --- climatology --------------------------------------------------------------------------------


def peak_ratios(
    df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START, min_peak_ratio: float = 5.0
) -> DataFrame:
    """Maximum over mean per year (30 days or more, positive mean) with the date of the peak."""
    d = F.datediff("date", F.lit("1970-01-01").cast("date"))
    y = observed_years(df, keys, start_month).groupBy(*keys, "hydro_year").agg(
        F.count("*").alias("n"), F.avg(val()).alias("mean_value"), F.max(val()).alias("peak_value"),
        F.max_by("date", F.struct(val(), -d)).alias("peak_date"),
    )
    enough = F.col("n") >= 30
    ratio = F.when(enough, S.div_pos(F.col("peak_value"), F.col("mean_value")))
    return y.select(
        *keys, "hydro_year", ratio.alias("peak_ratio"),
        F.when(enough, F.col("peak_value")).alias("peak_value"), F.when(enough, F.col("peak_date")).alias("peak_date"),
        F.when(enough, F.col("mean_value")).alias("mean_value"),
        F.coalesce(ratio >= min_peak_ratio, F.lit(False)).alias("has_seasonal_signal"),
    )


def flat_years(
    df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START,
    relative_threshold: float = 0.3, min_regime_peak_ratio: float = 10.0,
) -> DataFrame:
    """Years of a seasonal series whose peak ratio falls far below the series' upper quartile."""
    w = Window.partitionBy(*keys)
    r = F.col("peak_ratio")
    y = peak_ratios(df, keys, start_month).where(r.isNotNull()).select(
        *keys, "hydro_year", "peak_ratio",
        F.count("*").over(w).alias("n"), S.quantile("peak_ratio", 0.75).over(w).alias("p75"), F.max(r).over(w).alias("hi"),
    )
    seasonal = (F.col("p75") >= min_regime_peak_ratio) | (F.col("hi") >= 2 * min_regime_peak_ratio)
    flat = (F.col("n") >= 3) & seasonal & (r < F.col("p75") * relative_threshold)
    return y.select(*keys, "hydro_year", "peak_ratio", flat.alias("is_flat"))


def daily_climatology(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Day-of-year statistics over 1..366 for series with at least a year of values."""
    w = Window.partitionBy(*keys)
    obs = df.where(val().isNotNull()).select("*", F.count("*").over(w).alias("_n")).where("_n >= 365")
    q = lambda p: S.quantile(val(), p)
    stats = obs.groupBy(*keys, F.dayofyear("date").alias("day_of_year")).agg(
        F.avg(val()).alias("mean"), F.stddev_samp(val()).alias("std"), q(0.5).alias("median"), q(0.25).alias("q25"),
        q(0.75).alias("q75"), q(0.05).alias("q05"), q(0.95).alias("q95"), F.count("*").alias("count"),
    )
    grid = stats.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(366))).alias("day_of_year"))
    return grid.join(stats, [*keys, "day_of_year"], "left")


def year_deviation(df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START) -> DataFrame:
    """Correlation, normalised error, amplitude and bias of each year against the climatology.

    The day-of-year mean is a window over the same exchange and includes the judged year.
    """
    whole = Window.partitionBy(*keys)
    obs = observed_years(df, keys, start_month).withColumn("doy", F.dayofyear("date"))
    obs = obs.select(
        *keys, "hydro_year", "value",
        F.avg(val()).over(Window.partitionBy(*keys, "doy")).alias("clim"), F.count("*").over(whole).alias("tn"),
    )
    obs = obs.withColumn("clim_max", F.max("clim").over(whole)).where("tn >= 365")
    c = F.col("clim")
    y = obs.groupBy(*keys, "hydro_year").agg(
        F.count("*").alias("n_days"),
        S.corr("value", "clim").alias("r"),
        F.sqrt(F.avg((val() - c) ** 2)).alias("rmse"),
        F.avg(c).alias("cm"), F.max(val()).alias("ym"), F.max("clim_max").alias("xm"), F.avg(val() - c).alias("b"),
    )
    ok = F.col("n_days") >= 30
    r = F.when(~F.isnan("r"), F.col("r"))
    return y.select(
        *keys, "hydro_year",
        F.when(ok, r).alias("correlation"),
        F.when(ok, S.div_pos(F.col("rmse"), F.col("cm"))).alias("nrmse"),
        F.when(ok, S.div_pos(F.col("ym"), F.col("xm"))).alias("amplitude_ratio"),
        F.when(ok, F.col("b")).alias("bias"),
        (F.col("n_days") / F.when(ok, C.hydro_length(F.col("hydro_year"), start_month)).otherwise(365)).alias("completeness"),
        "n_days",
    )


def climatology_flags(
    dev: DataFrame, keys: Sequence[str] = KEY, min_correlation: float = 0.5, critical_correlation: float = 0.2,
    max_nrmse: float = 2.0, min_amplitude: float = 0.3, max_amplitude: float = 3.0,
) -> DataFrame:
    """Codes from a ``year_deviation`` table."""
    r, e, a = F.col("correlation"), F.col("nrmse"), F.col("amplitude_ratio")
    return dev.select(
        *keys, "hydro_year",
        flag_array(
            F.when(r < critical_correlation, "very_low_clim_correlation").when(r < min_correlation, "low_clim_correlation"),
            F.when(e > max_nrmse, "high_clim_nrmse"),
            F.when(a < min_amplitude, "low_amplitude").when(a > max_amplitude, "high_amplitude"),
        ).alias("flags"),
    )


# --- sensitivity and season checks --------------------------------------------------------------


def ice_window_sensitivity(
    df: DataFrame, temperature: DataFrame, keys: Sequence[str] = KEY, min_days: int = 30,
    fraction: float = 0.8, ice_months: Sequence[int] = ICE_MONTHS,
) -> DataFrame:
    """Constant runs judged by fixed ice months against days whose mean temperature is below zero.

    ``temperature`` is ``(keys, date, t)``.  One row per run with both shares and both verdicts.
    """
    runs = constant_runs(df, keys, min_days, ice_months=ice_months)
    cold = (
        temperature.groupBy(*keys, F.dayofyear("date").alias("doy"))
        .agg((F.avg("t") < 0).alias("frozen"))
    )
    days = runs.select("*", F.explode(F.sequence("start", "end")).alias("day")).withColumn("doy", F.dayofyear("day"))
    share = (
        days.join(cold, [*keys, "doy"], "left")
        .groupBy(*keys, "start", "end")
        .agg(F.avg(F.coalesce(F.col("frozen"), F.lit(False)).cast("double")).alias("cold_fraction"))
    )
    out = runs.join(share, [*keys, "start", "end"])
    return out.select(
        "*", (F.col("ice_fraction") < fraction).alias("flag_fixed"), (F.col("cold_fraction") < fraction).alias("flag_derived")
    )


def ice_window_summary(runs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Series flagged by the fixed window, exempted by the derived one, and newly flagged by it."""
    per = runs.groupBy(*keys).agg(F.max("flag_fixed").alias("a"), F.max("flag_derived").alias("b"))
    return per.agg(
        F.count_if("a").alias("n_flagged_fixed"),
        F.count_if(F.col("a") & ~F.col("b")).alias("n_exempt_derived"),
        F.count_if(~F.col("a") & F.col("b")).alias("n_new_derived"),
    )


def peak_winter_ratio(
    df: DataFrame, keys: Sequence[str] = KEY, min_coverage: float = 0.7, min_winter_days: int = 30
) -> DataFrame:
    """Annual maximum over January–March mean, for years with coverage and winter days enough."""
    y = observed_years(df, keys)
    winter = F.when(F.month("date") <= 3, val())
    y = y.groupBy(*keys, "hydro_year").agg(
        (F.count("*") / F.first(C.hydro_length(F.col("hydro_year")))).alias("coverage"),
        F.max(val()).alias("peak"), F.avg(winter).alias("winter_mean"), F.count(winter).alias("n_winter"),
    )
    return y.where(
        (F.col("coverage") >= min_coverage) & (F.col("n_winter") >= min_winter_days) & (F.col("winter_mean") > 0)
    ).select(*keys, "hydro_year", (F.col("peak") / F.col("winter_mean")).alias("ratio"))


def blank_interior_years(years: DataFrame, keys: Sequence[str] = KEY, year: str = "hydro_year") -> DataFrame:
    """Years without an assessment between the first and last assessed one."""
    w = Window.partitionBy(*keys).orderBy(year)
    nxt = F.lead(year).over(w)
    return years.select(*keys, year).distinct().select(*keys, year, nxt.alias("nxt")).where(
        F.col("nxt") > F.col(year) + 1
    ).select(*keys, F.explode(F.sequence(F.col(year) + 1, F.col("nxt") - 1)).alias(year))


def winter_gap_flags(
    df: DataFrame, keys: Sequence[str] = KEY, summer_min: float = 0.8, winter_max: float = 0.5
) -> DataFrame:
    """Series observed in summer (June–September) but not in winter (December–March)."""
    seen = val().isNotNull().cast("double")
    m = F.month("date")
    out = df.groupBy(*keys).agg(
        F.avg(F.when(m.isin(6, 7, 8, 9), seen)).alias("summer_presence"),
        F.avg(F.when(m.isin(12, 1, 2, 3), seen)).alias("winter_presence"),
    )
    return out.withColumn(
        "winter_gap", (F.col("summer_presence") > summer_min) & (F.col("winter_presence") < winter_max)
    )
