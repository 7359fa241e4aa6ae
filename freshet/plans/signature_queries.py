"""Queries for calendars and flow signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import signatures as S
from ..sources import tables as T
from .registry import joined_sql, presentable_sql, query

Q = "quantile_cont(value, {})".format
SLOPE = f"CASE WHEN {Q(0.67)} > 0 AND {Q(0.34)} > 0 THEN (ln({Q(0.67)}) - ln({Q(0.34)})) / 33.0 * 100 END"
CV = "stddev_pop(value) / nullif(avg(value), 0)"


def pos(a, b):
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def flow_sql(body: str, more: str = "") -> str:
    return f"WITH {T.FLOW_SQL}{', ' + more if more else ''} {body}"


# ---- calendar ----


@query("cal_daily_columns", "CAL-01 CAL-02 CAL-04", flow_sql(
    "SELECT series_id, date, CAST(m AS INTEGER) AS month, CAST(doy AS INTEGER) AS day_of_year, "
    "CAST(y AS INTEGER) AS year, CAST(hy AS INTEGER) AS hydro_year FROM flow"), dates="date")
def cal_daily_columns(spark, sf):
    return C.daily_columns(T.flow(spark, sf)).drop("value")


@query("cal_annual_totals", "CAL-03", flow_sql(
    "SELECT series_id, CAST(hy AS INTEGER) AS period, sum(value) AS total FROM flow GROUP BY 1, 2"), "total")
def cal_annual_totals(spark, sf):
    from ..operators import balance

    return balance.annual_totals(T.flow(spark, sf))


@query("cal_season_totals", "CAL-05", flow_sql("""
  SELECT series_id, CAST(y AS INTEGER) AS year, CASE WHEN m IN (12, 1, 2) THEN 'DJF' WHEN m <= 5 THEN 'MAM'
         WHEN m <= 8 THEN 'JJA' ELSE 'SON' END AS season, avg(value) AS mean, count(*) AS n
  FROM flow GROUP BY 1, 2, 3"""), "mean")
def cal_season_totals(spark, sf):
    d = F.col("date")
    return T.flow(spark, sf).groupBy(
        "series_id", F.year(d).alias("year"), C.season_code(d).alias("season")
    ).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("cal_seasonal_cycle", "CAL-06", flow_sql("""
  SELECT series_id, month, day, med, (med - min(med) OVER w) / nullif(max(med) OVER w - min(med) OVER w, 0) AS scaled
  FROM c WHERE n365 = 365 AND hi < 1000000 WINDOW w AS (PARTITION BY series_id)""",
  """c0 AS (SELECT series_id, CAST(m AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, median(value) AS med
     FROM flow WHERE NOT (m = 2 AND day(date) = 29) GROUP BY 1, 2, 3),
     c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n365, max(med) OVER (PARTITION BY series_id) AS hi FROM c0)"""),
  "med scaled")
def cal_seasonal_cycle(spark, sf):
    return S.seasonal_cycle(T.flow(spark, sf), max_value=1_000_000.0)


# ---- duration curve ----


@query("sig_exceedance_curve", "SIG-01", flow_sql("""
  SELECT series_id, date, value, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, date)
         / (count(*) OVER (PARTITION BY series_id) + 1.0) * 100 AS exceedance FROM flow"""), "value exceedance", "date")
def sig_exceedance_curve(spark, sf):
    return S.exceedance_curve(T.flow(spark, sf))


@query("sig_fdc_metrics", "SIG-02 SIG-03 SIG-04 SIG-05 SIG-06", flow_sql(f"""
  SELECT series_id, {', '.join(f"{Q(round(1 - p / 100, 6))} AS q{p:02d}" for p in S.EXCEEDANCE)}, {SLOPE} AS fdc_slope,
    {pos(Q(.95), Q(.05))} AS q5_q95_ratio, {pos(Q(.95), Q(.5))} AS q5_q50_ratio, {pos(Q(.5), Q(.05))} AS q50_q95_ratio,
    {pos(f'({Q(.75)} - {Q(.25)})', Q(.5))} AS iqr_ratio, avg(value) AS mean_flow, {Q(.5)} AS median_flow,
    {CV} AS cv_flow, skewness(value) AS skewness, kurtosis(value) AS kurtosis
  FROM flow GROUP BY 1"""),
  "q05 q10 q20 q30 q50 q70 q80 q90 q95 q99 fdc_slope q5_q95_ratio q5_q50_ratio q50_q95_ratio iqr_ratio mean_flow median_flow cv_flow skewness kurtosis")
def sig_fdc_metrics(spark, sf):
    return S.fdc_metrics(T.flow(spark, sf))


@query("sig_flow_regime", "SIG-07", flow_sql(f"""
  SELECT *, CASE WHEN slope_class = 'steep' AND variability_class = 'high' THEN 'flashy'
     WHEN slope_class = 'flat' AND variability_class = 'low' THEN 'stable' WHEN slope_class = 'moderate' THEN 'intermediate'
     ELSE variability_class || '_' || slope_class END AS flow_regime
  FROM (SELECT *, CASE WHEN fdc_slope < -1.5 THEN 'steep' WHEN fdc_slope > -0.5 THEN 'flat' ELSE 'moderate' END AS slope_class,
     CASE WHEN coefficient_variation < 0.5 THEN 'low' WHEN coefficient_variation > 1.5 THEN 'high' ELSE 'moderate' END AS variability_class
  FROM (SELECT series_id, {SLOPE} AS fdc_slope, {CV} AS coefficient_variation FROM flow GROUP BY 1))"""),
  "fdc_slope coefficient_variation")
def sig_flow_regime(spark, sf):
    return S.flow_regime(T.flow(spark, sf))


@query("sig_regime_classification", "SIG-22", flow_sql(f"""
  SELECT *, CASE WHEN fdc_slope IS NULL OR coefficient_of_variation IS NULL THEN 'unclassified'
    WHEN fdc_slope < -2.0 AND coefficient_of_variation > 1.0 THEN 'flashy'
    WHEN fdc_slope > -0.8 AND coefficient_of_variation < 0.7 THEN 'baseflow_dominated'
    WHEN fdc_slope BETWEEN -2.0 AND -0.8 THEN 'intermediate' ELSE 'variable' END AS regime_classification
  FROM (SELECT series_id, {CV} AS coefficient_of_variation, {SLOPE} AS fdc_slope,
    {pos(Q(.05), 'avg(value)')} AS baseflow_ratio_approx FROM flow GROUP BY 1)"""),
  "coefficient_of_variation fdc_slope baseflow_ratio_approx")
def sig_regime_classification(spark, sf):
    return S.regime_classification(T.flow(spark, sf))


# ---- extremes ----


@query("sig_flow_quantiles", "SIG-08", flow_sql(f"""
  SELECT series_id, {Q(.01)} AS q01_0, {Q(.05)} AS q05_0, {Q(.1)} AS q10_0, {Q(.9)} AS q90_0, {Q(.95)} AS q95_0,
  {Q(.99)} AS q99_0 FROM flow GROUP BY 1"""), "q01_0 q05_0 q10_0 q90_0 q95_0 q99_0")
def sig_flow_quantiles(spark, sf):
    return S.flow_quantiles(T.flow(spark, sf))


def _events_sql(src: str, cond: str, out: str) -> str:
    """Contiguous observed-day runs of ``cond`` as (series_id, n)."""
    return f"""{out} AS (SELECT series_id, g, count(*) AS n FROM (
      SELECT series_id, date, date - CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) AS INTEGER) AS g
      FROM {src} WHERE {cond}) GROUP BY 1, 2)"""


_THR = """th AS (SELECT *, 2.0 * median(value) OVER (PARTITION BY series_id) AS hi,
   0.2 * avg(value) OVER (PARTITION BY series_id) AS lo FROM src)"""


def _threshold_sql(src_cte: str) -> str:
    side = lambda s, lvl, op, ext, nm, ev: f"""
      max({lvl}) AS {s}_flow_threshold, count(*) FILTER (WHERE value {op} {lvl}) * 100.0 / count(*) AS {s}_flow_frequency,
      avg(value) FILTER (WHERE value {op} {lvl}) AS {s}_flow_mean, {ext}(value) FILTER (WHERE value {op} {lvl}) AS {s}_flow_{nm},
      coalesce((SELECT count(*) FROM {ev} e WHERE e.series_id = th.series_id), 0) AS {s}_flow_events,
      coalesce((SELECT avg(n) FROM {ev} e WHERE e.series_id = th.series_id), 0) AS {s}_flow_avg_duration,
      coalesce((SELECT max(n) FROM {ev} e WHERE e.series_id = th.series_id), 0) AS {s}_flow_max_duration"""
    return f"""WITH {src_cte}, {_THR}, {_events_sql('th', 'value > hi', 'eh')}, {_events_sql('th', 'value < lo', 'el')}
      SELECT series_id, {side('high', 'hi', '>', 'max', 'max', 'eh')}, {side('low', 'lo', '<', 'min', 'min', 'el')}
      FROM th GROUP BY series_id"""


_THR_D = " ".join(f"{s}_flow_{x}" for s, e in (("high", "max"), ("low", "min"))
                  for x in ("threshold", "frequency", "mean", e, "avg_duration"))


@query("sig_threshold_events", "SIG-09 SIG-10 SIG-11",
       _threshold_sql(T.FLOW_SQL + ", src AS (SELECT series_id, date, value FROM flow)"), _THR_D)
def sig_threshold_events(spark, sf):
    return S.threshold_events(T.flow(spark, sf))


@query("sig_threshold_events_sparse", "SIG-09 SIG-10 SIG-11",
       _threshold_sql(T.SUPPLIER_SQL + ", src AS (SELECT series_id, date, value FROM sup)"), _THR_D)
def sig_threshold_events_sparse(spark, sf):
    return S.threshold_events(T.supplier_flow(spark, sf))


@query("sig_low_flow_indices", "SIG-12", flow_sql(f"""
  SELECT series_id, max(lvl) AS q95_flow, {Q(.1)} AS q90_flow, {pos('max(lvl)', 'avg(value)')} AS bfi_approx,
   stddev_pop(CASE WHEN value <= lvl THEN value END) / nullif(avg(CASE WHEN value <= lvl THEN value END), 0) AS low_flow_cv,
   {pos('max(lvl)', Q(.5))} AS q95_ratio
  FROM (SELECT *, quantile_cont(value, 0.05) OVER (PARTITION BY series_id) AS lvl FROM flow) GROUP BY 1"""),
  "q95_flow q90_flow bfi_approx low_flow_cv q95_ratio")
def sig_low_flow_indices(spark, sf):
    return S.low_flow_indices(T.flow(spark, sf))


_RISE = "r AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS d FROM flow)"


@query("sig_flood_indices", "SIG-13", flow_sql(f"""
  SELECT r.series_id, {Q(.95)} AS q05_flow, {Q(.9)} AS q10_flow, max(f) AS mean_annual_flood, 2 * max(f) AS flood_threshold,
    count(*) FILTER (WHERE value > 2 * f) * 100.0 / count(*) AS flood_frequency, max(d) AS max_daily_rise,
    avg(d) FILTER (WHERE d > 0) AS mean_daily_rise, {pos('max(d)', 'avg(value)')} AS flashiness_index
  FROM r JOIN maf USING (series_id) GROUP BY 1""", _RISE + """,
  am AS (SELECT series_id, y, max(value) AS mx FROM flow GROUP BY 1, 2 HAVING count(*) > 300),
  maf AS (SELECT f.series_id, coalesce(any_value(a.f), avg(f.value)) AS f FROM flow f
     LEFT JOIN (SELECT series_id, avg(mx) AS f FROM am GROUP BY 1) a USING (series_id) GROUP BY 1)"""),
  "q05_flow q10_flow mean_annual_flood flood_threshold flood_frequency max_daily_rise mean_daily_rise flashiness_index")
def sig_flood_indices(spark, sf):
    return S.flood_indices(T.flow(spark, sf))


@query("sig_extreme_metrics", "SIG-14", joined_sql(
    ("", "sig_flow_quantiles"), ("", "sig_threshold_events"), ("", "sig_low_flow_indices"), ("", "sig_flood_indices")))
def sig_extreme_metrics(spark, sf):
    return S.extreme_metrics(T.flow(spark, sf))


@query("sig_extreme_ratios", "SIG-15", flow_sql(f"""
  SELECT series_id, {pos(Q(.95), Q(.05))} AS q05_q95_ratio, {pos(Q(.95), Q(.5))} AS q05_q50_ratio,
   {pos(Q(.5), Q(.05))} AS q50_q95_ratio, {pos(f'({Q(.95)} - {Q(.05)})', Q(.5))} AS extreme_range_ratio
  FROM flow GROUP BY 1"""), "q05_q95_ratio q05_q50_ratio q50_q95_ratio extreme_range_ratio")
def sig_extreme_ratios(spark, sf):
    return S.extreme_ratios(T.flow(spark, sf))


# ---- index families ----


@query("sig_magnitude_indices", "SIG-16", flow_sql(f"""
  SELECT series_id, avg(value) AS ma01, median(value) AS ma02,
   {', '.join(f"avg(value) FILTER (WHERE m = {i}) AS ma{i + 2:02d}" for i in range(1, 13))},
   stddev_pop(value) AS ma15, {pos('stddev_pop(value)', 'avg(value)')} AS ma16 FROM flow GROUP BY 1"""),
  " ".join(f"ma{i:02d}" for i in range(1, 17)))
def sig_magnitude_indices(spark, sf):
    return S.magnitude_indices(T.flow(spark, sf))


def _legacy_sql(hi: float, lo: float, src: str) -> str:
    """Elapsed-day durations: run start to the first row outside (or the last row), plus one."""
    per = lambda f: f"""d{f} AS (SELECT a.series_id, date_diff('day', a.date, coalesce((SELECT min(b.date) FROM b
        WHERE b.series_id = a.series_id AND b.date > a.date AND NOT b.{f}), a.last)) + 1 AS days
      FROM b a WHERE a.{f} AND NOT coalesce(a.p{f}, false))"""
    pick = lambda f, fn: f"coalesce((SELECT {fn}(days) FROM d{f} WHERE d{f}.series_id = b.series_id), 0)"
    return f"""WITH {src},
     b0 AS (SELECT series_id, date, value > {hi} * median(value) OVER w AS h, value < {lo} * avg(value) OVER w AS l,
        max(date) OVER w AS last FROM src WINDOW w AS (PARTITION BY series_id)),
     b AS (SELECT *, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM b0 WINDOW w AS (PARTITION BY series_id ORDER BY date)),
     {per('h')}, {per('l')}
     SELECT series_id, count(*) FILTER (WHERE h) * 100.0 / count(*) AS fh01, count(*) FILTER (WHERE h AND NOT ph) AS fh02,
       count(*) FILTER (WHERE l) * 100.0 / count(*) AS fl01, count(*) FILTER (WHERE l AND NOT pl) AS fl02,
       {pick('h', 'avg')} AS dh01, {pick('h', 'max')} AS dh02, {pick('l', 'avg')} AS dl01, {pick('l', 'max')} AS dl02
     FROM b GROUP BY series_id"""


_SRC_FLOW = T.FLOW_SQL + ", src AS (SELECT series_id, date, value FROM flow)"
_SRC_SUP = T.SUPPLIER_SQL + ", src AS (SELECT series_id, date, value FROM sup)"
_FD = "fh01 fh02 fl01 fl02 dh01 dh02 dl01 dl02"


@query("sig_frequency_duration_indices", "SIG-17 SIG-18", _legacy_sql(3.0, 0.1, _SRC_SUP), _FD)
def sig_frequency_duration_indices(spark, sf):
    return S.frequency_duration_indices(T.supplier_flow(spark, sf))


@query("sig_flow_duration_timing", "SIG-26", f"""SELECT series_id, fh01 AS high_flow_freq, fl01 AS low_flow_freq,
  dh01 AS high_flow_avg_duration, dl01 AS low_flow_avg_duration, dh02 AS high_flow_max_duration,
  dl02 AS low_flow_max_duration FROM ({_legacy_sql(2.0, 0.2, _SRC_FLOW)})""",
  "high_flow_freq low_flow_freq high_flow_avg_duration low_flow_avg_duration high_flow_max_duration low_flow_max_duration")
def sig_flow_duration_timing(spark, sf):
    return S.flow_duration_timing(T.flow(spark, sf))


_EXT = """e AS (SELECT series_id, y, count(*) AS n, max(date) AS last,
    arg_max(doy, struct_pack(v := value, d := -epoch(date))) AS mx, arg_min(doy, struct_pack(v := value, d := epoch(date))) AS mn
    FROM flow GROUP BY 1, 2)"""
_EXT = """e0 AS (SELECT series_id, y, doy, count(*) OVER (PARTITION BY series_id, y) AS n,
    row_number() OVER (PARTITION BY series_id, y ORDER BY value DESC, date) AS r1,
    row_number() OVER (PARTITION BY series_id, y ORDER BY value, date) AS r2 FROM flow),
  e AS (SELECT series_id, y, max(n) AS n, max(CASE WHEN r1 = 1 THEN doy END) AS mx, max(CASE WHEN r2 = 1 THEN doy END) AS mn
    FROM e0 GROUP BY 1, 2)"""


@query("sig_timing_indices", "SIG-19", flow_sql(
    "SELECT series_id, avg(mx) AS ta01, avg(mn) AS ta02 FROM e WHERE n > 300 GROUP BY 1", _EXT), "ta01 ta02")
def sig_timing_indices(spark, sf):
    return S.timing_indices(T.flow(spark, sf))


@query("sig_extreme_timing", "SIG-25", flow_sql("""SELECT series_id, avg(mx) AS max_timing_mean, stddev_pop(mx) AS max_timing_std,
   avg(mn) AS min_timing_mean, stddev_pop(mn) AS min_timing_std FROM e WHERE n >= 300 GROUP BY 1""", _EXT),
   "max_timing_mean max_timing_std min_timing_mean min_timing_std")
def sig_extreme_timing(spark, sf):
    return S.extreme_timing(T.flow(spark, sf))


@query("sig_rate_of_change", "SIG-20", flow_sql("""
  SELECT series_id, coalesce(avg(d) FILTER (WHERE d > 0), 0) AS ra01, coalesce(median(d) FILTER (WHERE d > 0), 0) AS ra02,
   coalesce(avg(-d) FILTER (WHERE d < 0), 0) AS ra03, coalesce(median(-d) FILTER (WHERE d < 0), 0) AS ra04,
   count(*) FILTER (WHERE d IS NOT NULL AND (pd IS NULL OR d <> pd)) AS ra05
  FROM (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY date) AS pd FROM r) GROUP BY 1""", _RISE),
  "ra01 ra02 ra03 ra04 ra05")
def sig_rate_of_change(spark, sf):
    return S.rate_of_change_indices(T.flow(spark, sf))


# ---- timing ----

_HFD = """c AS (SELECT series_id, hy, date, sum(value) OVER (PARTITION BY series_id, hy ORDER BY date) AS run,
    sum(value) OVER (PARTITION BY series_id, hy) AS total, count(*) OVER (PARTITION BY series_id, hy) AS n FROM flow),
  hfd AS (SELECT series_id, hy, date_diff('day', make_date(hy - 1, 10, 1), min(date)) + 1 AS hfd FROM c
    WHERE n >= 300 AND run >= total / 2 GROUP BY 1, 2)"""


@query("sig_half_flow_date", "SIG-23", flow_sql(
    "SELECT series_id, avg(hfd) AS hfd_mean, stddev_pop(hfd) AS hfd_std FROM hfd GROUP BY 1", _HFD), "hfd_mean hfd_std")
def sig_half_flow_date(spark, sf):
    return S.half_flow_date(T.flow(spark, sf))


_SEA = "CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m <= 5 THEN 'spring' WHEN m <= 8 THEN 'summer' ELSE 'autumn' END"


@query("sig_seasonal_flows", "SIG-24", flow_sql("SELECT series_id, " + ", ".join(
    f"""avg(value) FILTER (WHERE s = '{s}') AS {s}_mean, stddev_pop(value) FILTER (WHERE s = '{s}') AS {s}_std,
     stddev_pop(value) FILTER (WHERE s = '{s}') / avg(value) FILTER (WHERE s = '{s}') AS {s}_cv,
     avg(value) FILTER (WHERE s = '{s}') / avg(value) AS {s}_ratio""" for s in C.SEASONS)
    + f" FROM (SELECT *, {_SEA} AS s FROM flow) GROUP BY 1"),
    " ".join(f"{s}_{x}" for s in C.SEASONS for x in ("mean", "std", "cv", "ratio")))
def sig_seasonal_flows(spark, sf):
    return S.seasonal_flows(T.flow(spark, sf))


@query("sig_timing_metrics", "SIG-27", joined_sql(
    ("", "sig_seasonal_flows"), ("", "sig_half_flow_date"), ("", "sig_extreme_timing"), ("", "sig_flow_duration_timing")))
def sig_timing_metrics(spark, sf):
    return S.timing_metrics(T.flow(spark, sf))


@query("sig_regime_stability", "SIG-28", flow_sql("SELECT series_id, " + ", ".join(
    f"stddev_pop({s}) / avg({s}) AS {s}_interannual_cv" for s in C.SEASONS) + " FROM (SELECT series_id, y, " + ", ".join(
    f"avg(value) FILTER (WHERE s = '{s}') AS {s}" for s in C.SEASONS)
    + f" FROM (SELECT *, {_SEA} AS s FROM flow) GROUP BY 1, 2 HAVING count(*) >= 300) GROUP BY 1"),
    " ".join(f"{s}_interannual_cv" for s in C.SEASONS))
def sig_regime_stability(spark, sf):
    return S.regime_stability(T.flow(spark, sf))


# ---- variability ----


@query("sig_basic_statistics", "SIG-29", flow_sql(f"""
  SELECT series_id, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, var_pop(value) AS variance,
   {CV} AS cv, skewness(value) AS skewness, kurtosis(value) AS kurtosis, min(value) AS min, max(value) AS max,
   max(value) - min(value) AS range, {Q(.75)} - {Q(.25)} AS iqr FROM flow GROUP BY 1"""),
  "mean median std variance cv skewness kurtosis min max range iqr")
def sig_basic_statistics(spark, sf):
    return S.basic_statistics(T.flow(spark, sf))


@query("sig_temporal_variability", "SIG-30", flow_sql("""
  SELECT a.*, CASE WHEN n > 7 THEN stddev_pop_wd END AS weekly_change_std, CASE WHEN n > 7 THEN wcv END AS weekly_cv,
    CASE WHEN n > 30 AND nm > 1 THEN mcv END AS monthly_cv
  FROM (SELECT series_id, avg(d) AS daily_change_mean, stddev_pop(d) AS daily_change_std,
     stddev_pop(d) / nullif(abs(avg(d)), 0) AS daily_change_cv FROM r GROUP BY 1) a
  JOIN (SELECT series_id, count(*) AS n, stddev_pop(wd) AS stddev_pop_wd, stddev_pop(wk) / avg(wk) AS wcv FROM w2 GROUP BY 1) b USING (series_id)
  JOIN (SELECT series_id, count(*) AS nm, stddev_pop(mm) / avg(mm) AS mcv FROM
     (SELECT series_id, avg(value) AS mm FROM flow GROUP BY series_id, y, m) GROUP BY 1) c USING (series_id)""",
  _RISE + """, w1 AS (SELECT *, CASE WHEN count(*) OVER k = 7 THEN avg(value) OVER k END AS wk FROM r
     WINDOW k AS (PARTITION BY series_id ORDER BY date ROWS 6 PRECEDING)),
  w2 AS (SELECT *, wk - lag(wk) OVER (PARTITION BY series_id ORDER BY date) AS wd FROM w1)""").replace(
      "SELECT a.*,", "SELECT series_id, daily_change_mean, daily_change_std, daily_change_cv,"),
  "daily_change_mean daily_change_std daily_change_cv weekly_change_std weekly_cv monthly_cv")
def sig_temporal_variability(spark, sf):
    return S.temporal_variability(T.flow(spark, sf))


_LAGS = (1, 7, 30, 365)


@query("sig_autocorrelation", "SIG-31", flow_sql(
    "SELECT series_id, " + ", ".join(f"corr(value, l{k}) AS lag{k}_autocorr" for k in _LAGS) + " FROM (SELECT series_id, value, "
    + ", ".join(f"lag(value, {k}) OVER w AS l{k}" for k in _LAGS)
    + " FROM flow WINDOW w AS (PARTITION BY series_id ORDER BY date)) GROUP BY 1"),
    " ".join(f"lag{k}_autocorr" for k in _LAGS))
def sig_autocorrelation(spark, sf):
    return S.autocorrelation(T.flow(spark, sf))


_FLASH = """fl AS (SELECT series_id, CASE WHEN sum(value) FILTER (WHERE d IS NOT NULL) > 0 THEN
    sum(abs(d)) / sum(value) FILTER (WHERE d IS NOT NULL) END AS flashiness_index, avg(abs(d)) AS mean_abs_daily_change,
    max(abs(d)) AS max_abs_daily_change, stddev_pop(abs(d)) / avg(abs(d)) AS change_variability FROM r GROUP BY 1)"""


@query("sig_flashiness", "SIG-32", flow_sql("SELECT * FROM fl", _RISE + ", " + _FLASH),
       "flashiness_index mean_abs_daily_change max_abs_daily_change change_variability")
def sig_flashiness(spark, sf):
    return S.flashiness(T.flow(spark, sf))


@query("sig_seasonal_variability", "SIG-33", flow_sql("""
  SELECT series_id, stddev_pop(mm) / avg(mm) AS seasonal_cv, max(mm) - min(mm) AS seasonal_range, max(mm) AS max_monthly_mean,
   min(mm) AS min_monthly_mean, CASE WHEN min(mm) > 0 THEN max(mm) / min(mm) END AS seasonal_ratio, avg(cv) AS avg_within_month_cv
  FROM (SELECT series_id, m, avg(value) AS mm, stddev_samp(value) / nullif(avg(value), 0) AS cv FROM flow GROUP BY 1, 2) GROUP BY 1"""),
  "seasonal_cv seasonal_range max_monthly_mean min_monthly_mean seasonal_ratio avg_within_month_cv")
def sig_seasonal_variability(spark, sf):
    return S.seasonal_variability(T.flow(spark, sf))


@query("sig_interannual_variability", "SIG-34", flow_sql("""
  SELECT series_id, stddev_pop(a) / avg(a) AS interannual_cv, max(a) / nullif(min(a), 0) AS max_annual_ratio,
   stddev_pop(b) / avg(b) AS annual_max_cv, stddev_pop(c) / nullif(avg(c), 0) AS annual_min_cv, regr_slope(a, p) AS annual_mean_trend
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y) - 1 AS p FROM
   (SELECT series_id, y, avg(value) AS a, max(value) AS b, min(value) AS c FROM flow GROUP BY 1, 2)) GROUP BY 1 HAVING count(*) >= 2"""),
  "interannual_cv max_annual_ratio annual_max_cv annual_min_cv annual_mean_trend")
def sig_interannual_variability(spark, sf):
    return S.interannual_variability(T.flow(spark, sf))


@query("sig_variability_metrics", "SIG-35", joined_sql(*[("", f"sig_{n}") for n in (
    "basic_statistics", "temporal_variability", "autocorrelation", "flashiness", "seasonal_variability", "interannual_variability")]))
def sig_variability_metrics(spark, sf):
    return S.variability_metrics(T.flow(spark, sf))


_FD_FLOW = presentable_sql(_legacy_sql(3.0, 0.1, _SRC_FLOW), _FD, "")
_FREQ = f"SELECT series_id, fh01, fh02, fl01, fl02 FROM ({_FD_FLOW})"
_DUR = f"SELECT series_id, dh01, dh02, dl01, dl02 FROM ({_FD_FLOW})"


@query("sig_comprehensive_indices", "SIG-21", joined_sql(
    ("magnitude_", "sig_magnitude_indices"), ("frequency_", _FREQ), ("duration_", _DUR), ("timing_", "sig_timing_indices"),
    ("rate_", "sig_rate_of_change"), ("fdc_", "sig_fdc_metrics"), ("extreme_", "sig_extreme_metrics"),
    ("timing_detailed_", "sig_timing_metrics"), ("variability_", "sig_variability_metrics")))
def sig_comprehensive_indices(spark, sf):
    return S.comprehensive_indices(T.flow(spark, sf))


@query("sig_stability_index", "SIG-36", flow_sql("""
  SELECT *, greatest(0, least(1, 1.0 - (cv_component * 0.4 + (1 - autocorr_component) * 0.3 + flashiness_component * 0.3))) AS stability_index
  FROM (SELECT series_id, least(cv / 2, 1.0) AS cv_component, greatest(0.0, coalesce(r1, 0)) AS autocorr_component,
     coalesce(least(flashiness_index / 0.5, 1.0), 0.5) AS flashiness_component
   FROM (SELECT series_id, stddev_pop(value) / avg(value) AS cv, corr(value, value - d) AS r1 FROM r GROUP BY 1) JOIN fl USING (series_id))""",
  _RISE + ", " + _FLASH), "cv_component autocorr_component flashiness_component stability_index")
def sig_stability_index(spark, sf):
    return S.stability_index(T.flow(spark, sf))


# ---- period metrics ----


def period_sql(src: str, value: str) -> str:
    """Period metrics over forcing rows; ``value`` may be null on some rows."""
    ev = lambda cond, out: f"""{out} AS (SELECT series_id, period, count(*) AS e FROM (SELECT DISTINCT series_id, period,
       date - CAST(row_number() OVER (PARTITION BY series_id, period ORDER BY date) AS INTEGER) AS g FROM th WHERE {cond}) GROUP BY 1, 2)"""
    return f"""{src}, pr AS (SELECT series_id, date, {value} AS value, year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS period FROM forcing),
     fr AS (SELECT series_id, period, count(value) * 1.0 / count(*) AS frac FROM pr GROUP BY 1, 2),
     th AS (SELECT *, 2.0 * median(value) OVER w AS hi, 0.2 * avg(value) OVER w AS lo,
        sum(value) OVER (PARTITION BY series_id, period ORDER BY date) AS run, sum(value) OVER w AS total
       FROM pr WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id, period)),
     {ev('value > hi', 'eh')}, {ev('value < lo', 'el')},
     ym AS (SELECT series_id, period, avg(value) AS mean_discharge, median(value) AS median_discharge,
       stddev_pop(value) AS std_discharge, sum(value) AS total_discharge, {CV} AS cv_discharge, {SLOPE} AS fdc_slope,
       {Q(.95)} AS q05, {Q(.5)} AS q50, {Q(.05)} AS q95,
       count(*) FILTER (WHERE value > hi) * 100.0 / count(*) AS high_flow_frequency,
       coalesce(count(*) FILTER (WHERE value > hi) * 1.0 / max(eh.e), 0) AS high_flow_avg_duration,
       count(*) FILTER (WHERE value < lo) * 100.0 / count(*) AS low_flow_frequency,
       coalesce(count(*) FILTER (WHERE value < lo) * 1.0 / max(el.e), 0) AS low_flow_avg_duration,
       CASE WHEN count(*) >= 300 THEN date_diff('day', make_date(CAST(period AS INTEGER) - 1, 10, 1),
          min(date) FILTER (WHERE run >= total / 2)) + 1 END AS mean_half_flow_date
      FROM th LEFT JOIN eh USING (series_id, period) LEFT JOIN el USING (series_id, period) GROUP BY 1, 2),
     pm AS (SELECT series_id, period, {', '.join(f'CASE WHEN frac >= 0.7 THEN {c} END AS {c}' for c in S.PERIOD_METRICS)}
       FROM ym JOIN fr USING (series_id, period))"""


@query("sig_period_metrics", "SIG-37", "WITH " + period_sql(T.FORCING_SQL, "gappy")
       + " SELECT * REPLACE (CAST(period AS INTEGER) AS period) FROM pm", " ".join(S.PERIOD_METRICS))
def sig_period_metrics(spark, sf):
    return S.period_metrics(T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value")))


def _agg_sql(fn: str) -> str:
    cols = ", ".join(
        f"CASE WHEN count(*) >= 3 AND count({c}) >= 3 THEN {fn}({c}) END AS {c}" for c in S.PERIOD_METRICS)
    return f"""SELECT *, CASE WHEN mean_discharge > 0 THEN mean_discharge_std / mean_discharge END AS mean_discharge_cv
      FROM (SELECT series_id, {cols}, count(mean_discharge) AS n_valid_periods, stddev_pop(mean_discharge) AS mean_discharge_std
      FROM pm GROUP BY 1)"""


for _how, _fn in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop")):

    def _build(spark, sf, how=_how):
        return S.series_signatures(T.flow(spark, sf), how=how)

    query(f"sig_series_{_how}", "SIG-38 SIG-39 SIG-41", "WITH " + period_sql(T.FORCING_SQL, "value") + _agg_sql(_fn),
          " ".join(S.PERIOD_METRICS) + " mean_discharge_std mean_discharge_cv")(_build)


@query("sig_runoff_ratio", "SIG-40", flow_sql("""
  SELECT series_id, CASE WHEN count(q / p) >= 3 THEN avg(q / p) END AS runoff_ratio FROM
   (SELECT series_id, hy, sum(value) AS q, nullif(greatest(sum(p_a), 0), 0) AS p FROM flow JOIN forcing USING (series_id, date, value)
    GROUP BY 1, 2) GROUP BY 1"""), "runoff_ratio")
def sig_runoff_ratio(spark, sf):
    f = T.forcing(spark, sf)
    return S.runoff_ratio(f.select("series_id", "date", "value"), f.select("series_id", "date", F.col("p_a").alias("value")))


@query("sig_winter_ratio", "SIG-42", """WITH """ + T.FORCING_SQL + """, y AS (SELECT series_id, year(date) AS y,
   count(gappy) FILTER (WHERE month(date) <= 3) AS nw, count(*) FILTER (WHERE month(date) <= 3) AS rw,
   sum(gappy) FILTER (WHERE month(date) <= 3) AS sw, count(gappy) AS n, sum(gappy) AS s FROM forcing GROUP BY 1, 2)
  SELECT series_id, count(*) FILTER (WHERE nw * 1.0 / nullif(rw, 0) >= 0.7) AS n_valid_winter_seasons, sum(nw) * 1.0 / sum(rw) AS winter_coverage,
   CASE WHEN count(*) FILTER (WHERE nw * 1.0 / nullif(rw, 0) >= 0.7) >= 5 THEN (sum(sw) / sum(nw)) / (sum(s) / sum(n)) END AS winter_flow_ratio
  FROM y GROUP BY 1""", "winter_coverage winter_flow_ratio")
def sig_winter_ratio(spark, sf):
    return S.winter_ratio(T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value")))


@query("sig_network_summary", "SIG-45 SIG-43", "WITH " + period_sql(T.FORCING_SQL, "value") + """
  SELECT metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median
  FROM (UNPIVOT (SELECT series_id, period, CAST(mean_discharge AS DOUBLE) AS mean_discharge, CAST(cv_discharge AS DOUBLE) AS cv_discharge,
     CAST(fdc_slope AS DOUBLE) AS fdc_slope, CAST(q05 AS DOUBLE) AS q05, CAST(q95 AS DOUBLE) AS q95,
     CAST(mean_half_flow_date AS DOUBLE) AS mean_half_flow_date FROM pm)
   ON mean_discharge, cv_discharge, fdc_slope, q05, q95, mean_half_flow_date INTO NAME metric VALUE value) GROUP BY 1""",
   "mean std min max median")
def sig_network_summary(spark, sf):
    per = S.period_metrics(T.flow(spark, sf))
    return S.metric_summary(
        per, ["mean_discharge", "cv_discharge", "fdc_slope", "q05", "q95", "mean_half_flow_date"], ["series_id", "period"]
    )


@query("sig_slope_agreement", "SIG-44", "WITH " + period_sql(T.FORCING_SQL, "value") + f""",
   a AS (SELECT series_id, avg(fdc_slope) AS an FROM pm GROUP BY 1), w AS (SELECT series_id, {SLOPE} AS wh FROM forcing GROUP BY 1),
   b AS (SELECT *, rank() OVER (ORDER BY an) + (count(*) OVER (PARTITION BY an) - 1) / 2.0 AS ra,
     rank() OVER (ORDER BY wh) + (count(*) OVER (PARTITION BY wh) - 1) / 2.0 AS rw FROM a JOIN w USING (series_id) WHERE an IS NOT NULL AND wh IS NOT NULL)
  SELECT count(*) AS n, avg(CASE WHEN sign(an) = sign(wh) THEN 1.0 ELSE 0.0 END) AS sign_agreement, corr(ra, rw) AS rho,
   median((an - wh) / wh) AS median_rel_diff FROM b""", "sign_agreement rho median_rel_diff")
def sig_slope_agreement(spark, sf):
    return S.slope_agreement(T.flow(spark, sf))
