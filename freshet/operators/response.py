"""How flow answers water input: wet spells, event response, lag correlation, snow storage.

Input is the aligned daily table ``(keys, date, p, value[, t])``.  Pass ``keys`` with the
hydrological year included to judge each year on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import runs as R
from ..functions import stats as S
from .quality import flag_array

KEY = ("series_id",)
YEAR_KEY = ("series_id", "hydro_year")


def val() -> Column:
    return F.col("value")


def inp() -> Column:
    return F.col("p")



def precipitation_events(
    df: DataFrame, keys: Sequence[str] = KEY, threshold: float = 5.0, min_days: int = 1, gap_days: int = 2,
    p: str = "p",
) -> DataFrame:
    """Wet spells ``(keys, event_id, start, end, total)``.

    A spell ends the day before the first dry row (or on the last row).  A spell that begins
    within ``gap_days`` of the previous end joins it; rain of the gap days stays out of the total.
    """
    w = R.ordered(keys)
    obs = df.where(F.col(p).isNotNull()).select(*keys, "date", F.col(p).alias("p"))
    obs = R.mark_runs(obs, F.col("p") >= threshold, keys, contiguous=False)
    obs = obs.select("*", F.lead("run_flag").over(w).alias("nf"), F.lead("date").over(w).alias("nd"))
    last = F.when(F.col("nf") == False, F.date_sub("nd", 1)).when(F.col("nf").isNull(), F.col("date"))  # noqa: E712
    spells = obs.where("run_flag").groupBy(*keys, "run_id").agg(
        F.min("date").alias("start"), F.max(last).alias("end"), F.sum("p").alias("total")
    )
    ws = R.ordered(keys, "start")
    opens = F.coalesce(F.datediff("start", F.lag("end").over(ws)) > gap_days, F.lit(True))
    spells = spells.withColumn("opens", opens.cast("int"))
    spells = spells.withColumn("event_id", F.sum("opens").over(R.upto(keys, "start")))
    events = spells.groupBy(*keys, "event_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("total").alias("total")
    )
    return events.where(F.datediff("end", "start") + 1 >= min_days)


def event_response(
    df: DataFrame, keys: Sequence[str] = KEY, lag_window: int = 7, response_threshold: float = 0.1,
    threshold: float = 5.0, p: str = "p",
) -> DataFrame:
    """Share of spells after which flow rises above its three-day baseline.

    Spells are spread to days and matched by equality on the date, so no range join is needed.
    """
    k = list(keys)
    events = precipitation_events(df, keys, threshold, p=p)
    days = events.select(
        *k, "event_id", "start", "total",
        F.explode(F.sequence(F.date_sub("start", 3), F.date_add("end", lag_window))).alias("date"),
    )
    q = df.where(val().isNotNull()).select(*k, "date", "value")
    before = F.when(F.col("date") < F.col("start"), val())
    after = F.when(F.col("date") >= F.col("start"), val())
    per = days.join(q, [*k, "date"], "left").groupBy(*k, "event_id").agg(
        F.avg(before).alias("base"), F.max(after).alias("peak"), F.first("total").alias("total")
    )
    b, pk = F.col("base"), F.col("peak")
    rise = F.when(b > 0, S.div(pk - b, b)).otherwise(F.when(pk > 0, 1.0).otherwise(0.0))
    per = per.withColumn("hit", b.isNotNull() & pk.isNotNull() & (rise > response_threshold))
    n = F.count("*")
    return per.groupBy(*k).agg(
        (F.count_if("hit") / n).alias("event_response_rate"),
        n.alias("n_events"),
        F.count_if("hit").alias("n_responsive"),
        F.avg(F.when(F.col("hit") & (F.col("total") > 0), S.div(pk - b, F.col("total")))).alias("mean_response_ratio"),
    )


def lag_correlations(
    df: DataFrame, keys: Sequence[str] = KEY, max_lag: int = 14, min_pairs: int = 30, p: str = "p"
) -> DataFrame:
    """Correlation of input on day d with flow on day d + lag, one row per lag.

    Each lag is a range frame of one single day over the shared sort, so all lags cost one
    exchange instead of ``max_lag`` copies of the table.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy("_day")
    base = df.select(*keys, day.alias("_day"), F.col(p).alias("_p"), "value")
    ahead = [F.max("value").over(w.rangeBetween(k, k)).alias(f"q{k}") for k in range(max_lag + 1)]
    base = base.select(*keys, "_p", *ahead)
    stats = base.groupBy(*keys).agg(
        *[S.corr("_p", f"q{k}").alias(f"r{k}") for k in range(max_lag + 1)],
        *[F.count_if(F.col("_p").isNotNull() & F.col(f"q{k}").isNotNull()).alias(f"n{k}") for k in range(max_lag + 1)],
    )
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k in range(max_lag + 1)
        ])
    )
    out = stats.select(*keys, rows.alias("x")).select(*keys, "x.lag", "x.r", "x.n")
    return out.where((F.col("n") >= min_pairs) & F.col("r").isNotNull() & ~F.isnan("r"))


def cross_correlation(
    df: DataFrame, keys: Sequence[str] = KEY, max_lag: int = 14, min_pairs: int = 30, p: str = "p"
) -> DataFrame:
    """Largest lag correlation and its lag (the smallest lag on ties)."""
    return lag_correlations(df, keys, max_lag, min_pairs, p).groupBy(*keys).agg(
        F.max("r").alias("max_cross_correlation"),
        F.max_by("lag", F.struct("r", -F.col("lag"))).alias("optimal_lag_days"),
    )


def flashiness(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    w = R.ordered(keys)
    base = df.where(val().isNotNull()).select(*keys, "value", F.abs(val() - F.lag("value").over(w)).alias("d"))
    total = F.sum(F.when(F.col("d").isNotNull(), val()))
    return base.groupBy(*keys).agg(S.div_pos(F.sum("d"), total).alias("flashiness_index"))


def snow_partition(
    df: DataFrame, keys: Sequence[str] = KEY, snow_temp: float = 0.0, melt_temp: float = 0.0, melt_factor: float = 3.0
) -> DataFrame:
    """Rain, snow, melt, effective input and snow storage per day (degree-day scheme).

    Storage obeys ``S = max(S' + snow - potential melt, 0)``; that recursion has the closed form
    ``C - min(0, running minimum of C)`` with C the running sum, so two window sums replace the
    day-by-day loop.  Days without input or temperature contribute nothing and carry storage on.
    """
    t = F.col("t")
    w = R.upto(keys)
    ok = inp().isNotNull() & t.isNotNull()
    wet = F.greatest(inp(), F.lit(0.0))
    base = df.select(
        *df.columns,
        F.when(ok, F.when(t <= snow_temp, F.lit(0.0)).otherwise(wet)).alias("rain_input"),
        F.when(ok, F.when(t <= snow_temp, wet).otherwise(F.lit(0.0))).alias("snow_input"),
        F.when(ok & (t > melt_temp), melt_factor * (t - melt_temp)).otherwise(F.lit(0.0)).alias("_pot"),
    )
    step = F.coalesce("snow_input", F.lit(0.0)) - F.col("_pot")
    base = base.withColumn("_c", F.sum(step).over(w))
    base = base.withColumn("snowpack_proxy", F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w)))
    before = F.coalesce(F.lag("snowpack_proxy").over(R.ordered(keys)), F.lit(0.0))
    base = base.withColumn(
        "melt_input", F.when(ok, F.least(before + F.col("snow_input"), F.col("_pot")))
    )
    return base.withColumn("effective_input", F.col("rain_input") + F.col("melt_input")).drop("_pot", "_c")


def snow_aware_response(
    df: DataFrame, keys: Sequence[str] = KEY, threshold: float = 5.0, lag_window: int = 14,
    snow_fraction: float = 0.25, melt_factor: float = 3.0,
) -> DataFrame:
    """Event response and lag correlation against rain plus melt, with the snow share."""
    k = list(keys)
    part = snow_partition(df, keys, melt_factor=melt_factor)
    zero = F.lit(0.0)
    totals = part.groupBy(*k).agg(
        S.div_pos(F.coalesce(F.sum("snow_input"), zero), F.sum(F.greatest(inp(), zero))).alias("snow_fraction"),
        *[F.coalesce(F.sum(c), zero).alias(n) for c, n in (
            ("rain_input", "rain_total"), ("snow_input", "snow_total"), ("melt_input", "melt_total"),
            ("effective_input", "effective_input_total"))],
    )
    resp = event_response(part, keys, lag_window=lag_window, threshold=threshold, p="effective_input")
    corr = cross_correlation(part, keys, max_lag=lag_window, p="effective_input")
    out = totals.join(resp, k, "left").join(corr, k, "left").fillna(0, ["n_events", "n_responsive"])
    return out.withColumn(
        "is_snow_influenced", F.coalesce(F.col("snow_fraction") >= snow_fraction, F.lit(False))
    )


def with_years(df: DataFrame, start_month: int = C.HYDRO_START) -> DataFrame:
    return df.withColumn("hydro_year", C.hydro_year(F.col("date"), start_month))


def year_response(df: DataFrame, keys: Sequence[str] = YEAR_KEY, threshold: float = 5.0, gate: int = 0) -> DataFrame:
    """Lag correlation, event response and flashiness per (series, year), on rows of that year."""
    k = list(keys)
    years = df.groupBy(*k).agg(F.count("value").alias("n_q"), F.count("p").alias("n_p")).where("n_q > 0")
    if gate:
        years = years.where((F.col("n_q") >= gate) & (F.col("n_p") >= gate))
    return (
        years.select(*k)
        .join(cross_correlation(df, keys).withColumnRenamed("max_cross_correlation", "max_pq_correlation"), k, "left")
        .join(event_response(df, keys, threshold=threshold), k, "left")
        .join(flashiness(df, keys), k, "left")
        .fillna(0, ["n_events", "n_responsive"])
    )


def dead_year_flags(
    df: DataFrame, keys: Sequence[str] = YEAR_KEY, min_correlation: float = 0.1, min_response: float = 0.2,
    min_flashiness: float = 0.01, threshold: float = 5.0,
) -> DataFrame:
    """Flags of years in which flow does not answer precipitation (30 days of each required)."""
    y = year_response(df, keys, threshold, gate=30)
    r = F.col("max_pq_correlation")
    return y.select(
        *keys, "max_pq_correlation", "event_response_rate", "flashiness_index",
        flag_array(
            F.when(r < min_correlation, "very_low_pq_correlation").when(r < 0.2, "low_pq_correlation"),
            F.when(F.col("event_response_rate") < min_response, "no_precip_response"),
            F.when(F.col("flashiness_index") < min_flashiness, "low_flashiness"),
        ).alias("flags"),
    )


def snow_aware_dead_year_flags(
    df: DataFrame, keys: Sequence[str] = YEAR_KEY, min_correlation: float = 0.1, min_response: float = 0.2,
    min_flashiness: float = 0.01, threshold: float = 5.0, lag_window: int = 14, melt_factor: float = 3.0,
) -> DataFrame:
    """Same test against rain plus melt; years need 30 days of flow, input and temperature."""
    k = list(keys)
    gate = (
        df.groupBy(*k).agg(F.count("value").alias("a"), F.count("p").alias("b"), F.count("t").alias("c"))
        .where("a >= 30 AND b >= 30 AND c >= 30").select(*k)
    )
    m = snow_aware_response(df, keys, threshold, lag_window, melt_factor=melt_factor)
    y = gate.join(m, k, "left").join(flashiness(df, keys), k, "left")
    r = F.col("max_cross_correlation")
    return y.select(
        *k, F.col("max_cross_correlation").alias("max_pq_correlation"), "event_response_rate", "flashiness_index",
        flag_array(
            F.when(r < min_correlation, "very_low_effective_water_correlation").when(r < 0.2, "low_effective_water_correlation"),
            F.when(F.col("event_response_rate") < min_response, "no_effective_water_response"),
            F.when(F.col("flashiness_index") < min_flashiness, "low_flashiness"),
        ).alias("flags"),
    )
