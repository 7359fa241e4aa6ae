"""Year grades, series grades and their summaries.

Year results are long rows ``(series_id, hydro_year, grade, completeness, flags)``; the wide
grade matrix is only an export.  Ties follow the cited rules through ``max_by`` on structs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import stats as S
from ..functions.quantiles import exact_quantiles
from . import quality as Q
from . import response as MR

KEY = ("series_id",)
GRADES = ("A", "B", "C", "D", "F")
GRADE_ORDER = ("A", "B", "C", "D", "F", "ungraded")
# Flag families used by the counterfactual regrade.
PQ_FAMILY = ("very_low_pq_correlation", "low_pq_correlation")
CLIMATOLOGY_FAMILY = (
    "low_clim_correlation", "very_low_clim_correlation", "high_clim_nrmse", "low_amplitude", "high_amplitude",
    "no_seasonal_signal",
)


def grade_expr(
    flags: Column, completeness: Column, a: float = 0.95, b: float = 0.85, c: float = 0.7
) -> Column:
    """Grade of one year from its flags and completeness."""
    n = Q.severity_counts(flags)
    return (
        F.when(n["critical"] > 0, "F")
        .when((n["major"] >= 2) | (completeness < c), "D")
        .when((n["major"] >= 1) | (n["minor"] >= 5) | (completeness < b), "C")
        .when((n["minor"] >= 3) | (completeness < a), "B")
        .otherwise("A")
    )


def grade_years(evidence: DataFrame) -> DataFrame:
    """Attach the grade to rows holding ``flags`` and ``completeness``."""
    return evidence.withColumn("grade", grade_expr(F.col("flags"), F.col("completeness")))


def complete_years(
    df: DataFrame, keys: Sequence[str] = KEY, start_month: int = C.HYDRO_START, min_years: int = 3
) -> DataFrame:
    """Hydrological years with data inside the record's complete span, for series with enough.

    The first complete year begins at the first year start strictly after the month of the
    first value; a record that reaches the last month of a year counts that year.
    """
    w = Window.partitionBy(*keys)
    first, last = F.col("d0"), F.col("d1")
    y = Q.observed_years(df, keys, start_month).groupBy(*keys, "hydro_year").agg(
        F.min("date").alias("d0"), F.max("date").alias("d1")
    )
    y = y.select(*keys, "hydro_year", F.min("d0").over(w).alias("d0"), F.max("d1").over(w).alias("d1"))
    if start_month > 1:
        lo = F.year(first) + F.when(F.month(first) < start_month, 1).otherwise(2)
        hi = F.year(last) - F.when(F.month(last) >= start_month - 1, 0).otherwise(1)
        y = y.where(F.col("hydro_year").between(lo, hi))
    y = y.select(*keys, "hydro_year", F.count("*").over(w).alias("n"))
    return y.where(F.col("n") >= min_years).drop("n")


def assess(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    start_month: int = C.HYDRO_START,
    min_years: int = 3,
    with_precipitation: bool = True,
    snow_aware: bool = False,
    threshold: float = 5.0,
) -> DataFrame:
    """All detectors, merged flags and grade for each complete hydrological year.

    Input ``(keys, date, value[, p][, t])``.  Flag order is flat year, climatology, response,
    anomaly, with duplicates removed.
    """
    k = [*keys, "hydro_year"]
    years = complete_years(df, keys, start_month, min_years)
    dev = Q.year_deviation(df, keys, start_month)
    clim = Q.climatology_flags(dev, keys, 0.3, 0.1, 5.0, 0.1, 5.0).select(*k, F.col("flags").alias("f_clim"))
    flat = Q.flat_years(df, keys, start_month).select(*k, "peak_ratio", F.when(F.col("is_flat"), F.array(F.lit("no_seasonal_signal"))).alias("f_flat"))
    anom = Q.anomaly_flags(df, keys, start_month).select(*k, F.col("flags").alias("f_anom"))
    var = Q.annual_variance(df, keys, start_month).select(*k, "variance_ratio")
    full = Q.data_quality(df, keys, start_month).select(*k, F.col("completeness").alias("day_share"))
    flash = MR.flashiness(MR.with_years(df, start_month), k)
    out = (
        years.join(full, k, "left").join(dev.drop("n_days", "bias"), k, "left").join(clim, k, "left")
        .join(flat, k, "left").join(anom, k, "left").join(var, k, "left").join(flash, k, "left")
    )
    if with_precipitation:
        dated = MR.with_years(df, start_month)
        finder = MR.snow_aware_dead_year_flags if snow_aware else MR.dead_year_flags
        meteo = finder(dated, k, threshold=threshold).select(
            *k, "max_pq_correlation", "event_response_rate", F.col("flags").alias("f_met")
        )
        out = out.join(meteo, k, "left")
    else:
        none = F.lit(None).cast("double")
        out = out.select("*", none.alias("max_pq_correlation"), none.alias("event_response_rate"),
                         F.lit(None).cast("array<string>").alias("f_met"))
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(F.col(c), empty) for c in ("f_flat", "f_clim", "f_met", "f_anom")]
    out = out.withColumn("flags", F.array_distinct(F.concat(*parts)))
    out = out.withColumn("completeness", F.coalesce("completeness", "day_share"))
    return grade_years(out).select(
        *k, "grade", "peak_ratio", F.col("correlation").alias("clim_correlation"), F.col("nrmse").alias("clim_nrmse"),
        "amplitude_ratio", "event_response_rate", "max_pq_correlation", "flashiness_index", "completeness",
        "variance_ratio", "flags",
    )


def year_table(years: DataFrame) -> DataFrame:
    """Flat export of year results: comma-joined codes and flag counts."""
    n = Q.severity_counts(F.col("flags"))
    return years.select(
        *[c for c in years.columns if c != "flags"],
        F.array_join("flags", ",").alias("flag_codes"), F.size("flags").alias("n_flags"),
        n["critical"].alias("n_critical_flags"), n["major"].alias("n_major_flags"),
    )


def _rank(grade: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GRADES]), grade)


def series_grades(years: DataFrame, keys: Sequence[str] = KEY, grade: str = "grade") -> DataFrame:
    """Overall grade, usable share, recommendation and tier of each series.

    All A stays A; otherwise the most frequent grade other than F (ties to the worse, A lowered
    to B), then capped by the share of usable years.
    """
    g = F.col(grade)
    n = {x: F.count_if(g == x) for x in GRADES}
    per = years.groupBy(*keys).agg(
        F.count("*").alias("n_years_total"),
        (n["A"] + n["B"] + n["C"]).alias("n_years_usable"),
        n["A"].alias("n_years_excellent"), n["B"].alias("n_years_good"), n["C"].alias("nc"),
        n["D"].alias("n_years_poor"), n["F"].alias("n_years_fail"),
        F.sort_array(F.collect_list(F.when(g == "F", F.col("hydro_year")))).alias("excluded_years"),
    )
    counts = {"A": "n_years_excellent", "B": "n_years_good", "C": "nc", "D": "n_years_poor"}
    top = F.greatest(*[F.struct(F.col(c).alias("n"), F.lit(i).alias("r")) for i, (x, c) in enumerate(counts.items(), 1)])
    mode = F.when(top["n"] == 0, 5).otherwise(F.greatest(top["r"], F.lit(2)))
    usable = S.div(F.col("n_years_usable"), F.col("n_years_total"))
    rank = F.when(F.col("n_years_excellent") == F.col("n_years_total"), 1).otherwise(mode)
    rank = F.when(usable < 0.5, F.greatest(rank, F.lit(4))).when(usable < 0.7, F.greatest(rank, F.lit(3))).otherwise(rank)
    per = per.withColumn("usable_fraction", usable).withColumn(
        "overall_grade", F.element_at(F.array(*[F.lit(x) for x in GRADES]), rank)
    )
    o, u = F.col("overall_grade"), F.col("usable_fraction")
    rec = F.when(o.isin("A", "B") & (u >= 0.8), "Include").when((o == "C") | (u >= 0.5), "Use with caution").otherwise("Exclude")
    return per.drop("nc").select("*", rec.alias("recommendation"), F.when(rec == "Exclude", "poor").otherwise("decent").alias("new_tier"))


def attach_grades(
    daily: DataFrame, years: DataFrame, keys: Sequence[str] = KEY, min_values: int = 3 * 365
) -> DataFrame:
    """Put the year grade on each day of the series that hold enough values."""
    w = Window.partitionBy(*keys)
    day = daily.select("*", F.count("value").over(w).alias("_n"), C.hydro_year(F.col("date")).alias("hydro_year"))
    return day.where(F.col("_n") >= min_values).drop("_n").join(
        years.select(*keys, "hydro_year", "grade"), [*keys, "hydro_year"], "left"
    )


def coverage_summary(
    daily: DataFrame, grades: DataFrame, keys: Sequence[str] = KEY, level: str = "stage", full_days: int = 5844
) -> DataFrame:
    """Grade, presence of flow and level, and full coverage of each series."""
    per = daily.groupBy(*keys).agg(
        (F.count("value") > 0).alias("has_discharge"), (F.count(level) > 0).alias("has_level"),
        ((F.count("value") == F.count("*")) & (F.count("*") >= full_days)).alias("full_coverage"),
    )
    return per.join(grades.select(*keys, "overall_grade"), list(keys), "left").withColumn(
        "overall_grade", F.coalesce("overall_grade", F.lit("ungraded"))
    )


def year_grade_modes(daily: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Most frequent daily grade per hydrological year; ties go to the first letter."""
    n = daily.where("grade IS NOT NULL").groupBy(
        *keys, C.hydro_year(F.col("date")).alias("hydro_year"), "grade"
    ).agg(F.count("*").alias("n"))
    return n.groupBy(*keys, "hydro_year").agg(F.min_by("grade", F.struct(-F.col("n"), "grade")).alias("grade"))


def first_year_grades(daily: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """First non-null daily grade of each hydrological year."""
    return daily.where("grade IS NOT NULL").groupBy(*keys, C.hydro_year(F.col("date")).alias("hydro_year")).agg(
        F.min_by("grade", "date").alias("grade")
    )


def grade_matrix(years: DataFrame, first_year: int, last_year: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Wide export, one column per year; the year list is given, so no extra pass finds it."""
    return years.groupBy(*keys).pivot("hydro_year", list(range(first_year, last_year + 1))).agg(F.first("grade"))


def grade_counts(years: DataFrame, overall: DataFrame | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Years per grade, worst grade and recommendation per series."""
    g = F.col("grade")
    out = years.groupBy(*keys).agg(
        F.count("*").alias("n_years"), *[F.count_if(g == x).alias(f"n_{x}") for x in GRADES], F.max(g).alias("worst_grade")
    )
    if overall is None:
        return out
    share = (F.col("n_A") + F.col("n_B") + F.col("n_C")) / F.col("n_years")
    o = F.col("overall_grade")
    return out.join(overall.select(*keys, "overall_grade"), list(keys)).withColumn(
        "recommendation",
        F.when(o.isin("A", "B") & (share >= 0.8), "Include").when((o == "C") | (share >= 0.5), "Use with caution").otherwise("Exclude"),
    )


def grade_parity(ours: DataFrame, released: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Compare two year-grade tables cell by cell: assessed, matched, differing, one-sided."""
    k = [*keys, "hydro_year"]
    a, b = ours.select(*k, F.col("grade").alias("ga")), released.select(*k, F.col("grade").alias("gb"))
    j = a.join(b, k, "full_outer")
    return j.agg(
        F.count("ga").alias("n_assessed"), F.count("gb").alias("n_expected"),
        F.count_if(F.col("ga") == F.col("gb")).alias("n_equal"),
        F.count_if(~F.col("ga").eqNullSafe(F.col("gb"))).alias("n_mismatch"),
    )


def flag_census(years: DataFrame) -> DataFrame:
    """Years carrying each flag and their share of all assessed years.

    The total rides along as the count of a null code, so the table is read once.
    """
    codes = years.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "flags")).alias("flag"))
    n = codes.groupBy("flag").agg(F.count("*").alias("n_years"))
    total = F.max(F.when(F.col("flag").isNull(), F.col("n_years"))).over(Window.partitionBy())
    # One row per flag code (21 at most), so the unpartitioned window holds a handful of rows.
    return n.select("flag", "n_years", total.alias("n_assessed_years")).where("flag IS NOT NULL").withColumn(
        "share_pct", F.col("n_years") / F.col("n_assessed_years") * 100
    )


def split_codes(df: DataFrame, column: str = "flag_codes") -> DataFrame:
    """Comma-joined codes back to an array; an empty text is an empty array."""
    return df.withColumn("flags", F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda c: c != ""))


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands with the lowest edge included."""
    out = F.when(value.isNull() | (value < edges[0]) | (value > edges[-1]), F.lit(None).cast("string"))
    for hi, label in zip(edges[1:], labels):
        out = out.when(value <= hi, label)
    return out


def grade_by_band(
    grades: DataFrame, attribute: str, edges: Sequence[float], labels: Sequence[str], extra: Column | None = None
) -> DataFrame:
    """Grade shares per band of an attribute."""
    g = F.col("overall_grade")
    share = lambda c: F.avg(c.cast("double")) * 100
    aggs = [
        F.count("*").alias("n"), share(g == "A").alias("pct_a"), share(g == "B").alias("pct_b"),
        share(g.isin("D", "F")).alias("pct_df"),
    ]
    if extra is not None:
        aggs.append(share(extra).alias("pct_extra"))
    return grades.withColumn("band", band(F.col(attribute), edges, labels)).where("band IS NOT NULL").groupBy("band").agg(*aggs)


def counterfactual(years: DataFrame, families: dict[str, Sequence[str]], keys: Sequence[str] = KEY) -> DataFrame:
    """Series-grade counts after each flag family is switched off, next to the base."""
    variants = [F.struct(F.lit("base").alias("variant"), F.col("flags").alias("flags"))] + [
        F.struct(F.lit(n).alias("variant"), F.array_except("flags", F.array(*[F.lit(f) for f in fam])).alias("flags"))
        for n, fam in families.items()
    ]
    long = years.select(*keys, "hydro_year", "completeness", F.explode(F.array(*variants)).alias("v")).select(
        *keys, "hydro_year", "completeness", "v.variant", "v.flags"
    )
    overall = series_grades(grade_years(long), [*keys, "variant"])
    return overall.groupBy("variant", "overall_grade").agg(F.count("*").alias("n_series"))


def completeness_bar(years: DataFrame, bar: float = 0.85, keys: Sequence[str] = KEY) -> DataFrame:
    """Effect of ignoring the seasonal-signal flag in years below a completeness bar."""
    low = (F.col("completeness") < bar) & F.array_contains("flags", "no_seasonal_signal")
    rest = F.array_remove("flags", "no_seasonal_signal")
    both = years.select(
        *keys, "hydro_year", "grade", "completeness", "flags", low.alias("low"),
        F.when(low, grade_expr(rest, F.col("completeness"))).otherwise(F.col("grade")).alias("grade2"),
    )
    a = series_grades(both, keys).select(*keys, F.col("overall_grade").alias("a"))
    b = series_grades(both, keys, "grade2").select(*keys, F.col("overall_grade").alias("b"))
    n = both.groupBy(*keys).agg(
        F.count_if(F.col("grade") == "F").alias("f"),
        F.count_if((F.col("grade") == "F") & F.col("low") & (F.col("completeness") >= 0.5)).alias("s"),
    )
    return n.join(a, list(keys)).join(b, list(keys)).agg(
        F.sum("f").alias("n_fail_years"), F.sum("s").alias("n_suppressed_years"),
        F.count_if(F.col("a") != F.col("b")).alias("n_changed_series"),
    )


def grade_contrast(metrics: DataFrame, columns: Sequence[str], ids: Sequence[str] = KEY) -> DataFrame:
    """Median and quartiles of metrics for grade A against the other graded series."""
    long = (
        metrics.where(F.col("overall_grade").isin(*GRADES))
        .withColumn("group", F.when(F.col("overall_grade") == "A", "A").otherwise("rest"))
    )
    long = S.unpivot(long, [*ids, "group"], columns)
    n = long.groupBy("group", "metric").agg(F.count("value").alias("n"))
    q = exact_quantiles(long, ["group", "metric"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return n.join(q, ["group", "metric"])


def reliability(ids: DataFrame, years: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Share of assessed years graded A per series; ungraded series are kept with a null share."""
    per = years.groupBy(*keys).agg(
        F.count("grade").alias("n_assessed"), (F.count_if(F.col("grade") == "A") / F.count("grade") * 100).alias("pct_a")
    )
    return ids.select(*keys).distinct().join(per, list(keys), "left").fillna(0, ["n_assessed"])


def grade_profile(daily: DataFrame, grades: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Record length, mean, variation and missing share per grade: count, mean and median."""
    per = daily.groupBy(*keys).agg(
        (F.count("*") / 365.25).alias("years"), F.avg("value").alias("mean"), S.cv_samp("value").alias("cv"),
        ((1 - F.count("value") / F.count("*")) * 100).alias("missing_pct"),
    )
    per = per.join(grades.select(*keys, "overall_grade"), list(keys), "left").withColumn(
        "overall_grade", F.coalesce("overall_grade", F.lit("ungraded"))
    )
    names = ("years", "mean", "cv", "missing_pct")
    base = per.groupBy("overall_grade").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in names])
    for c in names:
        base = base.join(exact_quantiles(per, ["overall_grade"], c, {f"{c}_median": 0.5}), "overall_grade", "left")
    return base
