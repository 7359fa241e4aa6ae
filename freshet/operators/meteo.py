"""Temperature, extremes, seasonal statistics and climate classes of daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import distributions as D
from ..functions import runs as R
from ..functions import stats as S

KEY = ("series_id",)
SEASONS = ("Winter", "Spring", "Summer", "Autumn")


def val() -> Column:
    return F.col("value")



def season_name(date: Column) -> Column:
    return F.initcap(C.season(date))


# --- temperature ------------------------------------------------------------------------------------


def basic_statistics(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(val()).alias("mean"), F.stddev_samp(val()).alias("std"), F.min(val()).alias("min"), F.max(val()).alias("max"),
        S.quantile(val(), 0.5).alias("median"), S.quantile(val(), 0.25).alias("q25"), S.quantile(val(), 0.75).alias("q75"),
        F.count(val()).alias("count"), (F.count("*") - F.count(val())).alias("missing_count"),
    )


def annual_statistics(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    r = lambda c: F.round(c, 2)
    return df.groupBy(*keys, F.year("date").alias("year")).agg(
        r(F.avg(val())).alias("mean"), r(F.min(val())).alias("min"), r(F.max(val())).alias("max"), r(F.stddev_samp(val())).alias("std"),
        F.count(val()).alias("count"), r(S.quantile(val(), 0.1)).alias("q10"), r(S.quantile(val(), 0.9)).alias("q90"),
    )


def seasonal_statistics(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys, F.year("date").alias("year"), season_name(F.col("date")).alias("season")).agg(
        F.avg(val()).alias("mean"), F.min(val()).alias("min"), F.max(val()).alias("max"), F.stddev_samp(val()).alias("std")
    )


def temperature_extremes(
    df: DataFrame, keys: Sequence[str] = KEY, cold: float = -20.0, hot: float = 35.0
) -> DataFrame:
    """Cold and hot day counts, shares, longest row runs, coldest and hottest day."""
    m = R.mark_runs(df, val() <= cold, keys, contiguous=False, prefix="c")
    m = R.mark_runs(m, val() >= hot, keys, contiguous=False, prefix="h")
    m = m.select(
        "*",
        F.sum(F.col("c_flag").cast("int")).over(Window.partitionBy(*keys, "c_id")).alias("c_len"),
        F.sum(F.col("h_flag").cast("int")).over(Window.partitionBy(*keys, "h_id")).alias("h_len"),
    )
    d = F.datediff("date", F.lit("1970-01-01").cast("date"))
    n = F.count("*")
    return m.groupBy(*keys).agg(
        F.count_if("c_flag").alias("cold_days_count"), F.count_if("h_flag").alias("hot_days_count"),
        (F.count_if("c_flag") / n * 100).alias("cold_days_percentage"), (F.count_if("h_flag") / n * 100).alias("hot_days_percentage"),
        F.max("c_len").alias("max_consecutive_cold"), F.max("h_len").alias("max_consecutive_hot"),
        F.min_by("date", F.when(val().isNotNull(), F.struct(val(), d))).alias("coldest_date"), F.min(val()).alias("coldest"),
        F.max_by("date", F.when(val().isNotNull(), F.struct(val(), -d))).alias("hottest_date"), F.max(val()).alias("hottest"),
    )


def degree_days(df: DataFrame, keys: Sequence[str] = KEY, base: float = 10.0) -> DataFrame:
    """Daily growing and heating degree days."""
    zero = F.lit(0.0)
    return df.where(val().isNotNull()).select(
        *keys, "date", F.greatest(val() - base, zero).alias("growing"), F.greatest(base - val(), zero).alias("heating")
    )


def annual_degree_days(df: DataFrame, keys: Sequence[str] = KEY, base: float = 10.0) -> DataFrame:
    return degree_days(df, keys, base).groupBy(*keys, F.year("date").alias("year")).agg(
        F.sum("growing").alias("annual_gdd"), F.sum("heating").alias("annual_hdd")
    )


def frost_years(df: DataFrame, keys: Sequence[str] = KEY, threshold: float = 0.0) -> DataFrame:
    """First and last frost per year; years without frost are absent."""
    return df.where(val() <= threshold).groupBy(*keys, F.year("date").alias("year")).agg(
        F.min("date").alias("first_frost"), F.max("date").alias("last_frost"), F.count("*").alias("frost_days")
    )


def frost_summary(df: DataFrame, keys: Sequence[str] = KEY, threshold: float = 0.0) -> DataFrame:
    y = df.groupBy(*keys, F.year("date").alias("year")).agg(F.count_if(val() <= threshold).alias("f"), F.count("*").alias("n"))
    return y.groupBy(*keys).agg(
        F.sum("f").alias("total_frost_days"), (F.sum("f") / F.sum("n") * 100).alias("frost_percentage"),
        F.coalesce(F.avg(F.when(F.col("f") > 0, F.col("f"))), F.lit(0.0)).alias("average_frost_days_per_year"),
    )


def temperature_metrics(df: DataFrame, keys: Sequence[str] = KEY, cold: float = -20.0, hot: float = 35.0) -> DataFrame:
    """Basic statistics, extremes and frost summary in one row per series."""
    k = list(keys)
    return basic_statistics(df, keys).join(temperature_extremes(df, keys, cold, hot), k).join(frost_summary(df, keys), k)


# --- extreme events -----------------------------------------------------------------------------------


def percentile_thresholds(df: DataFrame, keys: Sequence[str] = KEY, low: float = 10, high: float = 90) -> DataFrame:
    return df.groupBy(*keys).agg(
        S.quantile(val(), low / 100).alias("low_threshold"), S.quantile(val(), high / 100).alias("high_threshold")
    )


def extreme_periods(
    df: DataFrame, keys: Sequence[str] = KEY, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Row runs at or below / at or above the thresholds; null means the 10 % / 90 % quantile.

    Duration is the elapsed days from first to last row of the run.
    """
    whole = Window.partitionBy(*keys)
    lo = S.quantile(val(), 0.1).over(whole) if low is None else F.lit(float(low))
    hi = S.quantile(val(), 0.9).over(whole) if high is None else F.lit(float(high))
    base = df.select(*keys, "date", "value", lo.alias("lo"), hi.alias("hi"))
    aggs = [F.avg(val()).alias("intensity_mean"), F.min(val()).alias("intensity_min"), F.max(val()).alias("intensity_max")]
    out = None
    for kind, flag in (("low", val() <= F.col("lo")), ("high", val() >= F.col("hi"))):
        e = R.event_table(base, flag, keys, contiguous=False, aggs=aggs).drop("run_id", "n_rows")
        e = e.select(*keys, F.lit(kind).alias("kind"), "start", "end",
                     (F.datediff("end", "start") + 1).alias("duration_days"), "intensity_mean", "intensity_min", "intensity_max")
        out = e if out is None else out.unionByName(e)
    return out


def extreme_shares(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Thresholds with the count and share of days beyond them."""
    whole = Window.partitionBy(*keys)
    base = df.select(*keys, "value", S.quantile(val(), 0.1).over(whole).alias("lo"), S.quantile(val(), 0.9).over(whole).alias("hi"))
    n = F.count("*")
    a, b = F.count_if(val() <= F.col("lo")), F.count_if(val() >= F.col("hi"))
    return base.groupBy(*keys).agg(
        F.max("lo").alias("low_threshold"), F.max("hi").alias("high_threshold"), a.alias("extreme_low_count"),
        b.alias("extreme_high_count"), (a / n * 100).alias("extreme_low_percentage"), (b / n * 100).alias("extreme_high_percentage"),
    )


def spell_events(
    df: DataFrame, keys: Sequence[str] = KEY, threshold: float = 30.0, min_days: int = 3, hot: bool = True
) -> DataFrame:
    """Runs of at least ``min_days`` rows beyond a threshold (duration counts rows)."""
    flag = val() >= threshold if hot else val() <= threshold
    aggs = [F.avg(val()).alias("intensity_mean"), F.min(val()).alias("intensity_min"), F.max(val()).alias("intensity_max")]
    e = R.event_table(df, flag, keys, contiguous=False, aggs=aggs)
    return e.where(F.col("n_rows") >= min_days).drop("run_id").withColumnRenamed("n_rows", "duration_days")


def spell_summary(
    df: DataFrame, keys: Sequence[str] = KEY, threshold: float = 30.0, min_days: int = 3, hot: bool = True
) -> DataFrame:
    """Number, days, mean and longest duration and peak intensity; series without events give zeros."""
    e = spell_events(df, keys, threshold, min_days, hot)
    peak = F.max("intensity_max") if hot else F.min("intensity_min")
    s = e.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.sum("duration_days").alias("total_days"),
        F.avg("duration_days").alias("average_duration"), F.max("duration_days").alias("maximum_duration"), peak.alias("peak_intensity"),
    )
    return df.select(*keys).distinct().join(s, list(keys), "left").fillna(0)


def annual_extremes(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys, F.year("date").alias("year")).agg(
        F.min(val()).alias("min"), F.max(val()).alias("max"), F.avg(val()).alias("mean"), F.stddev_samp(val()).alias("std"),
        S.quantile(val(), 0.01).alias("p01"), S.quantile(val(), 0.99).alias("p99"),
    )


def extreme_event_table(
    df: DataFrame, keys: Sequence[str] = KEY, heat: float = 30.0, cold: float = -10.0, min_days: int = 3
) -> DataFrame:
    """Quantile events, heat waves and cold spells in one long table."""
    base = extreme_periods(df, keys)
    for kind, thr, hot in (("heat_wave", heat, True), ("cold_spell", cold, False)):
        e = spell_events(df, keys, thr, min_days, hot).withColumn("kind", F.lit(kind))
        base = base.unionByName(e.select(*base.columns))
    return base


# --- seasonal statistics --------------------------------------------------------------------------------


def season_table(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Year rows with mean, sum, minimum and maximum per season as columns (one aggregation)."""
    s = season_name(F.col("date"))
    aggs = []
    for n in SEASONS:
        x = F.when(s == n, val())
        low = n.lower()
        aggs += [
            F.avg(x).alias(f"{low}_mean"), F.sum(x).alias(f"{low}_total"), F.min(x).alias(f"{low}_min"), F.max(x).alias(f"{low}_max")
        ]
    return df.groupBy(*keys, F.year("date").alias("year")).agg(*aggs)


def monthly_climatology(df: DataFrame, keys: Sequence[str] = KEY, years: tuple[int, int] | None = None) -> DataFrame:
    ref = df.where(F.year("date").between(*years)) if years else df
    return ref.groupBy(*keys, F.month("date").alias("month")).agg(F.avg(val()).alias("mean"))


def seasonal_anomalies(df: DataFrame, keys: Sequence[str] = KEY, years: tuple[int, int] | None = None) -> DataFrame:
    """Season mean of each year minus the season's mean over all reference days."""
    k = [*keys, "season"]
    d = df.withColumn("season", season_name(F.col("date"))).withColumn("year", F.year("date"))
    inside = F.col("year").between(*years) if years else F.lit(True)
    y = d.groupBy(*k, "year").agg(
        F.avg(val()).alias("mean"), F.sum(F.when(inside, val())).alias("s"), F.count(F.when(inside, val())).alias("n")
    )
    w = Window.partitionBy(*k)
    return y.select(*k, "year", (F.col("mean") - S.div(F.sum("s").over(w), F.sum("n").over(w))).alias("anomaly"))


def annual_cycle(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean, range, extreme months and first harmonic of the monthly means (rounded to 2 places)."""
    m = monthly_climatology(df, keys).withColumn("mean", F.round("mean", 2))
    v, x = F.col("mean"), 2 * F.pi() * (F.col("month") - 1) / 12
    out = m.groupBy(*keys).agg(
        F.avg(v).alias("annual_mean"), (F.max(v) - F.min(v)).alias("annual_range"),
        F.max_by("month", F.struct(v, -F.col("month"))).alias("max_month"),
        F.min_by("month", F.struct(v, F.col("month"))).alias("min_month"),
        F.coalesce(S.div(F.stddev_samp(v), F.avg(v)) * 100, F.lit(0.0)).alias("coefficient_of_variation"),
        F.when(F.count("*") == 12, F.avg(v * F.cos(x)) * 2).alias("a"), F.when(F.count("*") == 12, F.avg(v * F.sin(x)) * 2).alias("b"),
    )
    phase = F.atan2("b", "a")
    peak = phase * 12 / (2 * F.pi())
    return out.select(
        "*", phase.alias("phase_radians"), F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).alias("annual_amplitude"),
        (F.when(peak < 0, peak + 12).otherwise(peak) + 1).alias("peak_month_harmonic"),
    ).drop("a", "b")


def onset_dates(df: DataFrame, threshold: float, keys: Sequence[str] = KEY, rising: bool = True) -> DataFrame:
    """First date per year at or beyond a threshold; null where it is never reached."""
    hit = val() >= threshold if rising else val() <= threshold
    return df.groupBy(*keys, F.year("date").alias("year")).agg(F.min(F.when(hit, F.col("date"))).alias("onset"))


def seasonal_trends(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Least squares of season means on the year with the t test of the slope."""
    k = [*keys, "season"]
    y = df.groupBy(*keys, season_name(F.col("date")).alias("season"), F.year("date").cast("double").alias("year")).agg(F.avg(val()).alias("m"))
    out = y.where("m IS NOT NULL").groupBy(*k).agg(
        F.count("*").alias("n_years"), F.regr_slope("m", "year").alias("slope"), F.regr_intercept("m", "year").alias("intercept"),
        F.regr_r2("m", "year").alias("r_squared"),
    ).where("n_years >= 3")
    n, r2 = F.col("n_years"), F.col("r_squared")
    t = F.sqrt(S.div(r2 * (n - 2), F.greatest(1 - r2, F.lit(1e-300))))
    out = out.withColumn("p_value", D.student_p2(t, (n - 2).cast("double")))
    return out.select("*", (F.col("slope") * 10).alias("trend_per_decade"), (F.col("p_value") < 0.05).alias("trend_significant"))


def seasonal_union(df: DataFrame, keys: Sequence[str] = KEY, years: tuple[int, int] | None = None) -> DataFrame:
    """Season tables, climatology, anomalies, annual cycle and trends as one long table.

    ``keys, part, label, year, statistic, value``: label is the month or season, year is null where a
    part has none, and absent values have no row.
    """
    k = list(keys)

    def long(part: str, table: DataFrame, label: str | None, year: bool) -> DataFrame:
        ids = [*k, F.lit(part).alias("part"), (F.col(label).cast("string") if label else F.lit("")).alias("label"), (F.col("year").cast("int") if year else F.lit(None).cast("int")).alias("year")]
        values = [c for c in table.columns if c not in (*k, label, "year")]
        wide = table.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
        return wide.unpivot([*k, "part", "label", "year"], values, "statistic", "value").where(F.col("value").isNotNull())

    parts = [
        long("seasons", season_table(df, keys), None, True), long("climatology", monthly_climatology(df, keys, years), "month", False),
        long("anomalies", seasonal_anomalies(df, keys, years), "season", True), long("cycle", annual_cycle(df, keys), None, False),
        long("trends", seasonal_trends(df, keys).drop("trend_significant"), "season", False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out



# --- climate classes --------------------------------------------------------------------------------------


def climate_class(normals: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Climate class from monthly normals ``(keys, month, t, p)``; empty text when any is missing.

    The twelve months are folded by one aggregation, and the class is a ladder of expressions.  Normals count to six
    places, as decimals, so that sums next to a bound do not depend on the order of the months; exact halves are moved up first.
    """
    six = lambda c: F.round(F.col(c) + 1.3e-8, 6).cast("decimal(20,6)")
    normals = normals.select(*keys, "month", six("t").alias("t"), six("p").alias("p"))
    t, p, m = F.col("t"), F.col("p"), F.col("month")
    mean = lambda c: S.div(F.sum(c), F.count(c))
    halves = {"n": m.between(4, 9), "s": ~m.between(4, 9)}
    aggs = [
        F.count(t).alias("nt"), F.count(p).alias("np"), mean(t).alias("mat"), F.sum(p).cast("double").alias("map"), F.max(t).cast("double").alias("thot"),
        F.min(t).cast("double").alias("tcold"), F.min(p).cast("double").alias("pdry"), F.count_if(t > 10).alias("mon10"),
    ]
    for h, cond in halves.items():
        x = F.when(cond, p)
        aggs += [mean(F.when(cond, t)).alias(f"t_{h}"), *[f(x).cast("double").alias(f"{a}_{h}") for a, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]]
    g = normals.groupBy(*keys).agg(*aggs)
    north = F.col("t_n") >= F.col("t_s")
    pick = lambda a, first: F.when(north, F.col(f"{a}_{'n' if first else 's'}")).otherwise(F.col(f"{a}_{'s' if first else 'n'}"))
    g = g.select("*", *[pick(a, True).alias(f"{a}_summer") for a in ("sum", "min", "max")], *[pick(a, False).alias(f"{a}_winter") for a in ("sum", "min", "max")])
    c = F.col
    threshold = 2.0 * c("mat") + F.when(c("sum_winter") >= 0.7 * c("map"), 0.0).when(c("sum_summer") >= 0.7 * c("map"), 28.0).otherwise(14.0)
    dry_summer = (c("min_summer") < 40.0) & (c("min_summer") < c("max_winter") / 3.0)
    dry_winter = c("min_winter") < c("max_summer") / 10.0
    rain = (
        F.when(dry_summer & dry_winter, F.when(c("sum_winter") > c("sum_summer"), "s").otherwise("w"))
        .when(dry_summer, "s").when(dry_winter, "w").otherwise("f")
    )
    warm = F.when(c("thot") >= 22.0, "a").when(c("mon10") >= 4, "b")
    arid = F.concat(F.when(c("map") < 5.0 * threshold, "BW").otherwise("BS"), F.when(c("mat") >= 18.0, "h").otherwise("k"))
    label = (
        F.when((c("nt") != 12) | (c("np") != 12), "")
        .when(c("map") < 10.0 * threshold, arid)
        .when(c("tcold") >= 18.0, F.when(c("pdry") >= 60.0, "Af").when(c("pdry") >= 100.0 - c("map") / 25.0, "Am").otherwise("Aw"))
        .when(c("thot") <= 10.0, F.when(c("thot") > 0.0, "ET").otherwise("EF"))
        .when(c("tcold") > 0.0, F.concat(F.lit("C"), rain, warm.otherwise("c")))
        .otherwise(F.concat(F.lit("D"), rain, warm.when(c("tcold") < -38.0, "d").otherwise("c")))
    )
    return g.select(*keys, label.alias("climate_class"))


def monthly_normals(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean temperature per month and mean of the monthly totals from ``(keys, date, t, p)``."""
    m = df.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("t").alias("st"), F.count("t").alias("nt"), F.sum("p").alias("p")
    )
    return m.groupBy(*keys, "month").agg(S.div(F.sum("st"), F.sum("nt")).alias("t"), F.avg("p").alias("p"))


# --- product comparison -------------------------------------------------------------------------------------


def phase_partition(df: DataFrame, keys: Sequence[str] = KEY, year_days: float = 365.25) -> DataFrame:
    """Annual input on days below and at or above freezing, from ``(keys, date, p, t)``."""
    both = F.col("p").isNotNull() & F.col("t").isNotNull()
    years = F.count_if(both) / year_days
    return df.groupBy(*keys).agg(
        S.div(F.sum(F.when(both & (F.col("t") < 0), F.col("p"))), years).alias("sub_zero_mm_yr"),
        S.div(F.sum(F.when(both & (F.col("t") >= 0), F.col("p"))), years).alias("above_zero_mm_yr"),
    )


def phase_network(df: DataFrame, products: Sequence[str], keys: Sequence[str] = KEY, year_days: float = 365.25) -> DataFrame:
    """Per product and phase: annual input below and at or above freezing, averaged over the series.

    ``df`` is ``(keys, date, t, products…)``; years come from the calendar that all series span, and
    a series without input in a phase counts as zero.
    """
    span = df.agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    cold = F.col("t") < 0
    cells = [F.coalesce(F.sum(F.when(test, F.col(p))), F.lit(0.0)).alias(f"{p}|{phase}") for p in products for phase, test in (("sub_freezing", cold), ("above_freezing", ~cold))]
    sums = df.groupBy(*keys).agg(*cells)
    long = S.unpivot(sums, [], [c for c in sums.columns if c not in keys])
    mean = long.groupBy("metric").agg(F.avg("value").alias("total"))
    # ``span`` is a single row.
    return mean.join(F.broadcast(span)).select(
        F.substring_index("metric", "|", 1).alias("product"), F.substring_index("metric", "|", -1).alias("phase"), (F.col("total") / (F.col("days") / year_days)).alias("mm_per_year"))


def precipitation_table(df: DataFrame, products: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Per product: series with data, their share, and mean, deviation and mean variation of annual input."""
    k = list(keys)
    long = df.select(*k, "date", *[F.col(p).cast("double").alias(p) for p in products]).unpivot([*k, "date"], list(products), "product", "p")
    per = annual_precipitation(long, [*k, "product"])
    total = df.select(*k).distinct().agg(F.count("*").alias("n_total"))
    table = per.groupBy("product").agg(
        F.count("mean_annual_mm").alias("n_series"), F.avg("mean_annual_mm").alias("mean_annual_mm"), F.stddev_samp("mean_annual_mm").alias("std_annual_mm"), F.avg("interannual_cv").alias("mean_cv"))
    # ``total`` is a single row.
    return table.join(F.broadcast(total)).select("product", "n_series", (100 * F.col("n_series") / F.col("n_total")).alias("coverage_pct"), "mean_annual_mm", "std_annual_mm", "mean_cv")


def annual_precipitation(
    df: DataFrame, keys: Sequence[str] = KEY, annual_rule: str = "mean_times_rows", min_days: int = 1
) -> DataFrame:
    """Mean annual input and its variation between calendar years.

    ``annual_rule``: ``mean_times_rows`` (mean of the year times its rows), ``sum`` or ``mean_365``.
    """
    rules = {
        "mean_times_rows": F.avg("p") * F.count("*"), "sum": F.sum("p"), "mean_365": F.avg("p") * 365.25,
    }
    y = df.groupBy(*keys, F.year("date").alias("year")).agg(rules[annual_rule].alias("a"), F.count("p").alias("n"))
    return y.where(F.col("n") >= min_days).groupBy(*keys).agg(
        F.avg("a").alias("mean_annual_mm"), S.cv_samp("a").alias("interannual_cv"), F.count("*").alias("n_years")
    )


def product_agreement(
    forcing: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = KEY, min_days: int = 365
) -> DataFrame:
    """Daily correlation and mean bias of product pairs over their common days.

    Products are columns of one row per day, so no self-join is needed.
    """
    rows = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    long = forcing.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.pair", "r.x", "r.y").where("x IS NOT NULL AND y IS NOT NULL")
    return long.groupBy(*keys, "pair").agg(
        F.count("*").alias("n_days"), S.corr("x", "y").alias("r"), F.avg(F.col("x") - F.col("y")).alias("mean_bias")
    ).where(F.col("n_days") >= min_days)


def product_shares(means: DataFrame, a: str, b: str, region: Column) -> DataFrame:
    """Product difference per region: mean, share of series where the first is larger."""
    d = F.col(a) - F.col(b)
    return means.where(d.isNotNull()).groupBy(region.alias("region")).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_difference"), (F.avg((d > 0).cast("double")) * 100).alias("pct_first_larger")
    )


def season_means(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Overall mean and the four season means of each series."""
    s = C.season_code(F.col("date"))
    return df.groupBy(*keys).agg(F.avg(val()).alias("mean"), *[F.avg(F.when(s == x, val())).alias(x.lower()) for x in ("DJF", "MAM", "JJA", "SON")])
