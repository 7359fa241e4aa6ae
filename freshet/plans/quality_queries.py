"""Queries for quality control, response checks and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import grading as G
from ..operators import quality as Q
from ..operators import response as MR
from ..sources import tables as T
from .registry import query

WET = 250.0  # daily input that counts as wet in the shared demonstration series


def daily(spark, sf):
    """Aligned flow, input and temperature; flow is missing on days without well-discounted lines."""
    return T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value"), F.col("p_a").alias("p"), "t")


HYS = "(year({0}) + CASE WHEN month({0}) >= 10 THEN 1 ELSE 0 END)".format
LEN = "(date_diff('day', make_date(CAST(hy AS INTEGER) - 1, 10, 1), make_date(CAST(hy AS INTEGER), 10, 1)))"
D = T.FORCING_SQL + f""", d AS (SELECT series_id, date, gappy AS value, p_a AS p, t, {HYS('date')} AS hy FROM forcing),
  o AS (SELECT *, dayofyear(date) AS doy FROM d WHERE value IS NOT NULL)"""
SUP = T.SUPPLIER_SQL + f""", d AS (SELECT series_id, date, value, p, {HYS('date')} AS hy FROM sup),
  o AS (SELECT *, dayofyear(date) AS doy FROM d WHERE value IS NOT NULL)"""


def runs_cte(min_days: int) -> str:
    return f"""r1 AS (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY date)) <= 1e-6 THEN 0 ELSE 1 END AS b FROM o),
  r2 AS (SELECT *, sum(b) OVER (PARTITION BY series_id ORDER BY date) AS g FROM r1),
  runs AS (SELECT series_id, g, min(date) AS "start", max(date) AS "end", count(*) AS n_days, arg_min(value, date) AS run_value
    FROM r2 GROUP BY 1, 2 HAVING count(*) >= {min_days}),
  ice AS (SELECT series_id, g, avg(CASE WHEN month(x) IN (11, 12, 1, 2, 3, 4) THEN 1.0 ELSE 0.0 END) AS ice_fraction
    FROM (SELECT series_id, g, unnest(generate_series("start", "end", INTERVAL 1 DAY)) AS x FROM runs) GROUP BY 1, 2)"""


SPIKE = """s1 AS (SELECT *, count(value) OVER w AS k, median(value) OVER w AS rolling_median, mad(value) OVER w * 1.4826 AS sm,
    count(*) OVER (PARTITION BY series_id) AS n FROM o
    WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)),
  sc AS (SELECT series_id, date, value, hy, rolling_median, abs(value - rolling_median) / sm AS n_sigma
    FROM s1 WHERE n >= 30 AND k >= 10 AND sm > 0)"""

VAR = """v1 AS (SELECT series_id, hy, count(*) AS n, var_samp(value) AS yv FROM o GROUP BY 1, 2),
  v2 AS (SELECT a.series_id, a.hy, count(*) AS rn, var_samp(b.value) AS lv FROM v1 a JOIN o b ON a.series_id = b.series_id AND a.hy <> b.hy GROUP BY 1, 2),
  var AS (SELECT series_id, hy, CASE WHEN n >= 30 AND rn >= 365 THEN yv END AS year_variance,
      CASE WHEN n >= 30 AND rn >= 365 THEN lv END AS longterm_variance,
      CASE WHEN n >= 30 AND rn >= 365 AND lv > 0 THEN yv / lv END AS variance_ratio FROM v1 LEFT JOIN v2 USING (series_id, hy))"""

DQ = f"""dq AS (SELECT *, n_days * 1.0 / {LEN} AS completeness, n_zero * 1.0 / n_days AS zero_flow_fraction FROM
   (SELECT series_id, hy, count(*) AS n_days, count(*) FILTER (WHERE value < 0) AS n_negative_values,
     count(*) FILTER (WHERE value = 0) AS n_zero FROM o GROUP BY 1, 2)),
  dqf AS (SELECT *, list_filter([CASE WHEN completeness < 0.5 THEN 'very_low_completeness' WHEN completeness < 0.8 THEN 'low_completeness' END,
     CASE WHEN n_negative_values > 0 THEN 'negative_values' END, CASE WHEN zero_flow_fraction > 0.5 THEN 'zero_flow_dominant' END],
     lambda x: x IS NOT NULL) AS flags FROM dq)"""

RUN_YEARS = """ry AS (SELECT series_id, ice_fraction, hy, date_diff('day', greatest("start", make_date(hy - 1, 10, 1)),
     least("end", make_date(hy, 10, 1) - 1)) + 1 AS od
   FROM (SELECT series_id, g, "start", "end", CAST(unnest(generate_series(""" + HYS('"start"') + ", " + HYS('"end"') + """)) AS INTEGER) AS hy FROM runs)
   JOIN ice USING (series_id, g))"""

ANOM = """anom AS (SELECT series_id, hy, list_concat(list_filter([c, s], lambda x: x IS NOT NULL), flags) AS f_anom FROM dqf
   LEFT JOIN (SELECT DISTINCT series_id, hy, 'constant_value' AS c FROM ry WHERE ice_fraction < 0.8) USING (series_id, hy)
   LEFT JOIN (SELECT DISTINCT series_id, hy, 'implausible_spike' AS s FROM sc WHERE n_sigma > 8.0) USING (series_id, hy))"""

PEAK = """pk AS (SELECT series_id, hy, n, mean_value, peak_value, peak_date, CASE WHEN n >= 30 AND mean_value > 0 THEN peak_value / mean_value END AS peak_ratio
   FROM (SELECT series_id, hy, count(*) AS n, avg(value) AS mean_value, max(value) AS peak_value FROM o GROUP BY 1, 2)
   JOIN (SELECT series_id, hy, min(date) AS peak_date FROM (SELECT *, max(value) OVER (PARTITION BY series_id, hy) AS mx FROM o)
      WHERE value = mx GROUP BY 1, 2) USING (series_id, hy)),
  fl AS (SELECT series_id, hy, peak_ratio, n3 >= 3 AND (p75 >= {m} OR hi >= 2 * {m}) AND peak_ratio < p75 * {rel} AS is_flat
   FROM (SELECT *, count(*) OVER w AS n3, quantile_cont(peak_ratio, 0.75) OVER w AS p75, max(peak_ratio) OVER w AS hi
     FROM pk WHERE peak_ratio IS NOT NULL WINDOW w AS (PARTITION BY series_id)))""".format

DEV = f"""c1 AS (SELECT *, avg(value) OVER (PARTITION BY series_id, doy) AS clim, count(*) OVER (PARTITION BY series_id) AS tn FROM o),
  c2 AS (SELECT *, max(clim) OVER (PARTITION BY series_id) AS xm FROM c1 WHERE tn >= 365),
  dev AS (SELECT series_id, hy, CASE WHEN n_days >= 30 THEN r END AS correlation, CASE WHEN n_days >= 30 AND cm > 0 THEN rmse / cm END AS nrmse,
    CASE WHEN n_days >= 30 AND xm > 0 THEN ym / xm END AS amplitude_ratio, CASE WHEN n_days >= 30 THEN b END AS bias,
    n_days * 1.0 / CASE WHEN n_days >= 30 THEN {LEN} ELSE 365 END AS completeness, n_days
   FROM (SELECT series_id, hy, count(*) AS n_days, corr(value, clim) AS r, sqrt(avg((value - clim) ** 2)) AS rmse, avg(clim) AS cm,
     max(value) AS ym, max(xm) AS xm, avg(value - clim) AS b FROM c2 GROUP BY 1, 2))"""


def clim_flags(c1, c0, e, lo, hi):
    return f"""list_filter([CASE WHEN correlation < {c0} THEN 'very_low_clim_correlation' WHEN correlation < {c1} THEN 'low_clim_correlation' END,
     CASE WHEN nrmse > {e} THEN 'high_clim_nrmse' END,
     CASE WHEN amplitude_ratio < {lo} THEN 'low_amplitude' WHEN amplitude_ratio > {hi} THEN 'high_amplitude' END], lambda x: x IS NOT NULL)"""


def events_cte(keys: str, thr: float, src: str = "d", p: str = "p", gap: int = 2) -> str:
    on = " AND ".join(f"e.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    return f"""e1 AS (SELECT {keys}, date, {p} AS p, {p} >= {thr} AS f FROM {src} WHERE {p} IS NOT NULL),
  e2 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - row_number() OVER (PARTITION BY {keys}, f ORDER BY date) AS g,
     lead(date) OVER (PARTITION BY {keys} ORDER BY date) AS nd FROM e1),
  e3 AS (SELECT {keys}, g, min(date) AS st, coalesce(max(nd) - 1, max(date)) AS en0, max(date) AS lastd, sum(p) AS total,
     bool_or(nd IS NULL) AS open FROM e2 WHERE f GROUP BY {keys}, g),
  e3b AS (SELECT *, CASE WHEN open THEN lastd ELSE en0 END AS en FROM e3),
  e4 AS (SELECT *, CASE WHEN st - lag(en) OVER (PARTITION BY {keys} ORDER BY st) <= {gap} THEN 0 ELSE 1 END AS o1 FROM e3b),
  e5 AS (SELECT *, sum(o1) OVER (PARTITION BY {keys} ORDER BY st) AS event_id FROM e4),
  ev AS (SELECT {keys}, CAST(event_id AS BIGINT) AS event_id, min(st) AS "start", max(en) AS "end", sum(total) AS total FROM e5 GROUP BY {keys}, event_id)""", on


def response_cte(keys: str, thr: float, lag: int = 7, src: str = "d", p: str = "p") -> str:
    ev, on = events_cte(keys, thr, src, p)
    ek = ", ".join("e." + k.strip() for k in keys.split(","))
    return ev + f""", rp AS (SELECT {ek}, e.event_id, any_value(e.total) AS total,
     avg(q.value) FILTER (WHERE q.date < e."start") AS b, max(q.value) FILTER (WHERE q.date >= e."start") AS pk
     FROM ev e LEFT JOIN {src} q ON {on} AND q.date BETWEEN e."start" - 3 AND e."end" + {lag} GROUP BY {ek}, e.event_id),
   rq AS (SELECT *, b IS NOT NULL AND pk IS NOT NULL AND (CASE WHEN b > 0 THEN (pk - b) / b WHEN pk > 0 THEN 1.0 ELSE 0.0 END) > 0.1 AS hit FROM rp),
   resp AS (SELECT {keys}, count(*) FILTER (WHERE hit) * 1.0 / count(*) AS event_response_rate, count(*) AS n_events,
     count(*) FILTER (WHERE hit) AS n_responsive, avg((pk - b) / total) FILTER (WHERE hit AND total > 0) AS mean_response_ratio FROM rq GROUP BY {keys})"""


def lag_cte(keys: str, src: str = "d", p: str = "p", max_lag: int = 14) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join("a." + k.strip() for k in keys.split(","))
    return f"""lc AS (SELECT {ak}, lag, corr(a.{p}, b.value) AS r, count(*) AS n
     FROM {src} a CROSS JOIN (SELECT unnest(range(0, {max_lag + 1})) AS lag) JOIN {src} b ON {on} AND b.date = a.date + CAST(lag AS INTEGER)
     WHERE a.{p} IS NOT NULL AND b.value IS NOT NULL GROUP BY {ak}, lag HAVING count(*) >= 30),
   xc AS (SELECT {keys}, max(r) AS max_cross_correlation, min(lag) AS optimal_lag_days
     FROM (SELECT *, max(r) OVER (PARTITION BY {keys}) AS mr FROM lc WHERE r IS NOT NULL AND NOT isnan(r)) WHERE r = mr GROUP BY {keys})"""


FLASHY = """fa AS (SELECT series_id, hy, sum(abs(dd)) / nullif(sum(CASE WHEN dd IS NOT NULL THEN value END), 0) AS flashiness_index
   FROM (SELECT *, value - lag(value) OVER (PARTITION BY series_id, hy ORDER BY date) AS dd FROM o) GROUP BY 1, 2)"""


# ---- runs, spikes, variance ----


@query("qc_constant_runs", "QC-01 QC-02", f"""WITH {SUP}, {runs_cte(2)}
  SELECT series_id, "start", "end", n_days, run_value, ice_fraction FROM runs JOIN ice USING (series_id, g)""",
  "run_value ice_fraction", '"start" "end"')
def qc_constant_runs(spark, sf):
    return Q.constant_runs(T.supplier_flow(spark, sf), min_days=2)


@query("qc_spike_scores", "QC-03", f"WITH {D}, {SPIKE} SELECT * EXCLUDE (hy) FROM sc", "value rolling_median n_sigma", "date")
def qc_spike_scores(spark, sf):
    return Q.spike_scores(daily(spark, sf))


@query("qc_spike_sensitivity", "QC-16", f"""WITH {SUP}, {SPIKE}, t AS (SELECT series_id, max(n_sigma) AS pk FROM (SELECT DISTINCT series_id FROM o)
   LEFT JOIN sc USING (series_id) GROUP BY 1)
  SELECT s AS sigma, count(*) AS n_series, count(*) FILTER (WHERE pk > s) AS n_with_spike, count(*) FILTER (WHERE pk > s) * 100.0 / count(*) AS pct
  FROM t CROSS JOIN (SELECT unnest([2.0, 5.0, 8.0]) AS s) GROUP BY 1""", "sigma pct")
def qc_spike_sensitivity(spark, sf):
    return Q.spike_sensitivity(T.supplier_flow(spark, sf), sigmas=(2.0, 5.0, 8.0))


@query("qc_annual_variance", "QC-04", f"WITH {D}, {VAR} SELECT CAST(hy AS INTEGER) AS hydro_year, * EXCLUDE (hy) FROM var",
       "year_variance longterm_variance variance_ratio")
def qc_annual_variance(spark, sf):
    return Q.annual_variance(daily(spark, sf)).select(
        "series_id", "hydro_year", "year_variance", "longterm_variance", "variance_ratio")


@query("qc_annual_variance_test", "QC-04")
def qc_annual_variance_test(spark, sf):
    return Q.annual_variance(daily(spark, sf))


@query("qc_data_quality", "QC-05", f"""WITH {D}, {DQ} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, n_days, completeness,
  n_negative_values, zero_flow_fraction, array_to_string(flags, ',') AS flags FROM dqf""", "completeness zero_flow_fraction")
def qc_data_quality(spark, sf):
    return Q.data_quality(daily(spark, sf))


@query("qc_anomaly_flags", "QC-06", f"""WITH {D}, {runs_cte(3)}, {RUN_YEARS}, {SPIKE}, {DQ}, {ANOM}
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, array_to_string(f_anom, ',') AS flags FROM anom""")
def qc_anomaly_flags(spark, sf):
    return Q.anomaly_flags(daily(spark, sf), constant_min_days=3)


@query("qc_anomaly_metrics", "QC-07", f"""WITH {D}, {runs_cte(2)}, {RUN_YEARS}, {SPIKE}, {DQ}
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, n_days, completeness, n_negative_values, zero_flow_fraction,
    CAST(coalesce(cd, 0) AS BIGINT) AS constant_days, coalesce(ns, 0) AS n_spikes, coalesce(cd, 0) * 1.0 / {LEN} AS constant_fraction
  FROM dq LEFT JOIN (SELECT series_id, hy, sum(od) AS cd FROM ry GROUP BY 1, 2) USING (series_id, hy)
  LEFT JOIN (SELECT series_id, hy, count(*) AS ns FROM sc WHERE n_sigma > 3.0 GROUP BY 1, 2) USING (series_id, hy)""",
  "completeness zero_flow_fraction constant_fraction")
def qc_anomaly_metrics(spark, sf):
    return Q.anomaly_metrics(daily(spark, sf), sigma=3.0, min_constant=2, with_variance=False)


# ---- climatology ----


@query("qc_peak_ratios", "QC-08 QC-09", f"""WITH {D}, {PEAK(m=10.0, rel=0.3)} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, peak_ratio,
  CASE WHEN n >= 30 THEN peak_value END AS peak_value, CASE WHEN n >= 30 THEN peak_date END AS peak_date,
  CASE WHEN n >= 30 THEN mean_value END AS mean_value, coalesce(peak_ratio >= 5.0, false) AS has_seasonal_signal FROM pk""",
  "peak_ratio peak_value mean_value", "peak_date")
def qc_peak_ratios(spark, sf):
    return Q.peak_ratios(daily(spark, sf))


@query("qc_flat_years", "QC-10 GRD-12", f"""WITH {SUP}, {PEAK(m=1.5, rel=0.8)}
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, peak_ratio, is_flat FROM fl""", "peak_ratio")
def qc_flat_years(spark, sf):
    return Q.flat_years(T.supplier_flow(spark, sf), relative_threshold=0.8, min_regime_peak_ratio=1.5)


@query("qc_daily_climatology", "QC-11", f"""WITH {D}, ok AS (SELECT series_id FROM o GROUP BY 1 HAVING count(*) >= 365),
  g AS (SELECT series_id, CAST(unnest(range(1, 367)) AS INTEGER) AS day_of_year FROM ok),
  s AS (SELECT series_id, doy AS day_of_year, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median, quantile_cont(value, .25) AS q25,
    quantile_cont(value, .75) AS q75, quantile_cont(value, .05) AS q05, quantile_cont(value, .95) AS q95, count(*) AS "count" FROM o GROUP BY 1, 2)
  SELECT * FROM g LEFT JOIN s USING (series_id, day_of_year)""", "mean std median q25 q75 q05 q95")
def qc_daily_climatology(spark, sf):
    return Q.daily_climatology(daily(spark, sf))


@query("qc_year_deviation", "QC-12 QC-14", f"WITH {D}, {DEV} SELECT CAST(hy AS INTEGER) AS hydro_year, * EXCLUDE (hy) FROM dev",
       "correlation nrmse amplitude_ratio bias completeness")
def qc_year_deviation(spark, sf):
    return Q.year_deviation(daily(spark, sf))


@query("qc_climatology_flags", "QC-13", f"""WITH {D}, {DEV} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year,
  array_to_string({clim_flags(0.5, 0.2, 0.5, 0.3, 1.2)}, ',') AS flags FROM dev""")
def qc_climatology_flags(spark, sf):
    return Q.climatology_flags(Q.year_deviation(daily(spark, sf)), max_nrmse=0.5, max_amplitude=1.2)


@query("qc_flag_severity", "QC-15", f"""WITH {D}, {runs_cte(2)}, {RUN_YEARS}, {SPIKE}, {DQ}, {ANOM}
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, CAST(len(f_anom) AS INTEGER) AS n_flags,
   CAST(len(list_filter(f_anom, lambda x: x IN ('no_seasonal_signal', 'very_low_completeness', 'negative_values'))) AS INTEGER) AS n_critical,
   CAST(len(list_filter(f_anom, lambda x: x IN ('very_low_clim_correlation', 'constant_value', 'low_completeness'))) AS INTEGER) AS n_major FROM anom""")
def qc_flag_severity(spark, sf):
    f = Q.anomaly_flags(daily(spark, sf), constant_min_days=2)
    n = Q.severity_counts(F.col("flags"))
    return f.select("series_id", "hydro_year", F.size("flags").alias("n_flags"), n["critical"].alias("n_critical"), n["major"].alias("n_major"))


@query("qc_ice_window_sensitivity", "QC-17", f"""WITH {D}, {runs_cte(2)},
  cold AS (SELECT series_id, dayofyear(date) AS doy, avg(t) < 0 AS fz FROM d GROUP BY 1, 2),
  cf AS (SELECT series_id, g, avg(CASE WHEN coalesce(fz, false) THEN 1.0 ELSE 0.0 END) AS cold_fraction FROM
    (SELECT series_id, g, dayofyear(unnest(generate_series("start", "end", INTERVAL 1 DAY))) AS doy FROM runs) LEFT JOIN cold USING (series_id, doy) GROUP BY 1, 2)
  SELECT series_id, "start", "end", n_days, run_value, ice_fraction, cold_fraction, ice_fraction < 0.8 AS flag_fixed, cold_fraction < 0.8 AS flag_derived
  FROM runs JOIN ice USING (series_id, g) JOIN cf USING (series_id, g)""", "run_value ice_fraction cold_fraction", '"start" "end"')
def qc_ice_window_sensitivity(spark, sf):
    d = daily(spark, sf)
    return Q.ice_window_sensitivity(d, d.select("series_id", "date", "t"), min_days=2)


@query("qc_ice_window_summary", "QC-17")
def qc_ice_window_summary(spark, sf):
    d = daily(spark, sf)
    return Q.ice_window_summary(Q.ice_window_sensitivity(d, d.select("series_id", "date", "t"), min_days=2))


@query("qc_peak_winter_ratio", "QC-19", f"""WITH {D} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, mx / wm AS ratio FROM
  (SELECT series_id, hy, count(*) * 1.0 / {LEN} AS cov, max(value) AS mx, avg(value) FILTER (WHERE month(date) <= 3) AS wm,
   count(*) FILTER (WHERE month(date) <= 3) AS nw FROM o GROUP BY 1, 2) WHERE cov >= 0.7 AND nw >= 30 AND wm > 0""", "ratio")
def qc_peak_winter_ratio(spark, sf):
    return Q.peak_winter_ratio(daily(spark, sf))


@query("qc_blank_interior_years", "QC-20", f"""WITH {SUP}, y AS (SELECT series_id, hy FROM o GROUP BY 1, 2 HAVING count(*) >= 80),
  r AS (SELECT series_id, CAST(unnest(range(min(hy), max(hy) + 1)) AS INTEGER) AS hydro_year FROM y GROUP BY 1)
  SELECT r.* FROM r ANTI JOIN y ON r.series_id = y.series_id AND r.hydro_year = y.hy""")
def qc_blank_interior_years(spark, sf):
    y = Q.data_quality(T.supplier_flow(spark, sf)).where("n_days >= 80")
    return Q.blank_interior_years(y)


@query("qc_winter_gap", "QC-21", f"""WITH {D} SELECT *, summer_presence > 0.8 AND winter_presence < 0.5 AS winter_gap FROM (SELECT series_id,
   avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE month(date) IN (6, 7, 8, 9)) AS summer_presence,
   avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE month(date) IN (12, 1, 2, 3)) AS winter_presence FROM d GROUP BY 1)""",
   "summer_presence winter_presence")
def qc_winter_gap(spark, sf):
    return Q.winter_gap_flags(daily(spark, sf))


# ---- response ----


@query("mr_precipitation_events", "MR-01", f"WITH {SUP}, {events_cte('series_id', 60)[0]} SELECT * FROM ev", "total", '"start" "end"')
def mr_precipitation_events(spark, sf):
    return MR.precipitation_events(T.supplier_flow(spark, sf), threshold=60)


@query("mr_event_response", "MR-02", f"WITH {D}, {response_cte('series_id', WET)} SELECT * FROM resp",
       "event_response_rate mean_response_ratio")
def mr_event_response(spark, sf):
    return MR.event_response(daily(spark, sf), threshold=WET)


@query("mr_lag_correlations", "MR-03", f"WITH {D}, {lag_cte('series_id')} SELECT series_id, CAST(lag AS INTEGER) AS lag, r, n FROM lc", "r")
def mr_lag_correlations(spark, sf):
    return MR.lag_correlations(daily(spark, sf))


@query("mr_cross_correlation", "MR-03", f"WITH {D}, {lag_cte('series_id')} SELECT series_id, max_cross_correlation, CAST(optimal_lag_days AS INTEGER) AS optimal_lag_days FROM xc",
       "max_cross_correlation")
def mr_cross_correlation(spark, sf):
    return MR.cross_correlation(daily(spark, sf))


SNOW = """n1 AS (SELECT *, CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN CASE WHEN t <= 0 THEN 0.0 ELSE p END END AS rain_input,
    CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN CASE WHEN t <= 0 THEN p ELSE 0.0 END END AS snow_input,
    CASE WHEN p IS NOT NULL AND t > 0 THEN 3.0 * t ELSE 0.0 END AS pot FROM d),
  n2 AS (SELECT *, sum(coalesce(snow_input, 0) - pot) OVER (PARTITION BY {k} ORDER BY date) AS c FROM n1),
  n3 AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY {k} ORDER BY date)) AS snowpack_proxy FROM n2),
  n4 AS (SELECT *, CASE WHEN snow_input IS NOT NULL THEN least(coalesce(lag(snowpack_proxy) OVER (PARTITION BY {k} ORDER BY date), 0) + snow_input, pot) END AS melt_input FROM n3),
  sn AS (SELECT *, rain_input + melt_input AS effective_input FROM n4)""".format


@query("mr_snow_partition", "MR-04", f"""WITH {D}, {SNOW(k='series_id')} SELECT series_id, date, rain_input, snow_input, melt_input,
  effective_input, snowpack_proxy FROM sn""", "rain_input snow_input melt_input effective_input snowpack_proxy", "date")
def mr_snow_partition(spark, sf):
    return MR.snow_partition(daily(spark, sf)).select(
        "series_id", "date", "rain_input", "snow_input", "melt_input", "effective_input", "snowpack_proxy")


@query("mr_snow_aware_response", "MR-05", f"""WITH {D}, {SNOW(k='series_id')}, {response_cte('series_id', 100, 14, 'sn', 'effective_input')},
  {lag_cte('series_id', 'sn', 'effective_input')},
  tt AS (SELECT series_id, sum(snow_input) / sum(greatest(p, 0)) AS snow_fraction, sum(rain_input) AS rain_total, sum(snow_input) AS snow_total,
    sum(melt_input) AS melt_total, sum(effective_input) AS effective_input_total FROM sn GROUP BY 1)
  SELECT *REPLACE (CAST(optimal_lag_days AS INTEGER) AS optimal_lag_days), snow_fraction >= 0.25 AS is_snow_influenced
  FROM tt JOIN resp USING (series_id) JOIN xc USING (series_id)""",
  "snow_fraction rain_total snow_total melt_total effective_input_total event_response_rate mean_response_ratio max_cross_correlation")
def mr_snow_aware_response(spark, sf):
    return MR.snow_aware_response(daily(spark, sf), threshold=100.0)


GATE = "gt AS (SELECT series_id, hy FROM d GROUP BY 1, 2 HAVING count(value) >= 30 AND count(p) >= 30)"
DEADF = """list_filter([CASE WHEN max_cross_correlation < 0.1 THEN 'very_low_pq_correlation' WHEN max_cross_correlation < 0.2 THEN 'low_pq_correlation' END,
   CASE WHEN event_response_rate < 0.2 THEN 'no_precip_response' END, CASE WHEN flashiness_index < 0.01 THEN 'low_flashiness' END], lambda x: x IS NOT NULL)"""
DEAD = f"""dead AS (SELECT series_id, hy, max_cross_correlation AS max_pq_correlation, event_response_rate, flashiness_index, {DEADF} AS f_met
   FROM gt LEFT JOIN xc USING (series_id, hy) LEFT JOIN resp USING (series_id, hy) LEFT JOIN fa USING (series_id, hy))"""
YK = "series_id, hy"


@query("mr_dead_year_flags", "MR-06", f"""WITH {D}, {response_cte(YK, WET)}, {lag_cte(YK)}, {FLASHY}, {GATE}, {DEAD}
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, max_pq_correlation, event_response_rate, flashiness_index, array_to_string(f_met, ',') AS flags FROM dead""",
  "max_pq_correlation event_response_rate flashiness_index")
def mr_dead_year_flags(spark, sf):
    return MR.dead_year_flags(MR.with_years(daily(spark, sf)), threshold=WET)


@query("mr_snow_aware_dead_years", "MR-07", f"""WITH {D}, {SNOW(k=YK)}, {response_cte(YK, 100, 14, 'sn', 'effective_input')},
  {lag_cte(YK, 'sn', 'effective_input')}, {FLASHY}, gt AS (SELECT series_id, hy FROM d GROUP BY 1, 2 HAVING count(value) >= 30 AND count(p) >= 30 AND count(t) >= 30), {DEAD}
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, max_pq_correlation, event_response_rate, flashiness_index,
    replace(replace(replace(array_to_string(f_met, ','), 'low_pq_correlation', 'low_effective_water_correlation'), 'no_precip_response', 'no_effective_water_response'), '', '') AS flags FROM dead""",
  "max_pq_correlation event_response_rate flashiness_index")
def mr_snow_aware_dead_years(spark, sf):
    return MR.snow_aware_dead_year_flags(MR.with_years(daily(spark, sf)), threshold=100.0)


@query("mr_year_response", "MR-08", f"""WITH {D}, {response_cte(YK, WET)}, {lag_cte(YK)}, {FLASHY}
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, max_cross_correlation AS max_pq_correlation, CAST(optimal_lag_days AS DOUBLE) AS optimal_lag_days, event_response_rate,
   coalesce(n_events, 0) AS n_events, coalesce(n_responsive, 0) AS n_responsive, mean_response_ratio, flashiness_index
  FROM (SELECT DISTINCT series_id, hy FROM o) LEFT JOIN xc USING (series_id, hy) LEFT JOIN resp USING (series_id, hy) LEFT JOIN fa USING (series_id, hy)""",
  "max_pq_correlation optimal_lag_days event_response_rate mean_response_ratio flashiness_index")
def mr_year_response(spark, sf):
    return MR.year_response(MR.with_years(daily(spark, sf)), threshold=WET).withColumn("optimal_lag_days", F.col("optimal_lag_days").cast("double"))


# ---- grading ----

GRADE = """CASE WHEN cr > 0 THEN 'F' WHEN mj >= 2 OR completeness < 0.7 THEN 'D' WHEN mj >= 1 OR mi >= 5 OR completeness < 0.85 THEN 'C'
   WHEN mi >= 3 OR completeness < 0.95 THEN 'B' ELSE 'A' END"""


def grade_cte(src: str, out: str, keys: str = "series_id, hy", grade: str = "grade") -> str:
    return f"""{out} AS (SELECT *, {GRADE} AS {grade} FROM (SELECT *,
     len(list_filter(flags, lambda x: x IN ('no_seasonal_signal', 'very_low_completeness', 'negative_values'))) AS cr,
     len(list_filter(flags, lambda x: x IN ('very_low_clim_correlation', 'constant_value', 'low_completeness'))) AS mj,
     len(flags) - len(list_filter(flags, lambda x: x IN ('no_seasonal_signal', 'very_low_completeness', 'negative_values',
       'very_low_clim_correlation', 'constant_value', 'low_completeness'))) AS mi FROM {src}))"""


COMPLETE = """cy0 AS (SELECT series_id, min(date) AS d0, max(date) AS d1 FROM o GROUP BY 1),
  cy1 AS (SELECT DISTINCT series_id, hy FROM o JOIN cy0 USING (series_id)
    WHERE hy BETWEEN year(d0) + CASE WHEN month(d0) < 10 THEN 1 ELSE 2 END AND year(d1) - CASE WHEN month(d1) >= 9 THEN 0 ELSE 1 END),
  cy AS (SELECT series_id, hy FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM cy1) WHERE n >= 3)"""

ASSESS = f"""{D}, {runs_cte(30)}, {RUN_YEARS}, {SPIKE}, {DQ}, {ANOM}, {PEAK(m=10.0, rel=0.3)}, {DEV}, {VAR},
  {response_cte(YK, WET)}, {lag_cte(YK)}, {FLASHY}, {GATE}, {DEAD}, {COMPLETE},
  a0 AS (SELECT cy.series_id, cy.hy, dev.completeness, correlation, nrmse, amplitude_ratio, fl.peak_ratio, variance_ratio, fa.flashiness_index,
     dead.max_pq_correlation, dead.event_response_rate,
     list_concat(list_concat(CASE WHEN is_flat THEN ['no_seasonal_signal'] ELSE [] END, {clim_flags(0.3, 0.1, 5.0, 0.1, 5.0)}), list_concat(coalesce(f_met, []), coalesce(f_anom, []))) AS flags
   FROM cy LEFT JOIN dev USING (series_id, hy) LEFT JOIN fl USING (series_id, hy) LEFT JOIN anom USING (series_id, hy)
   LEFT JOIN var USING (series_id, hy) LEFT JOIN fa USING (series_id, hy) LEFT JOIN dead USING (series_id, hy)),
  {grade_cte('a0', 'yr')}"""


def overall_cte(src: str, out: str, keys: str = "series_id", grade: str = "grade") -> str:
    return f"""{out}0 AS (SELECT {keys}, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE {grade} = '{g}') AS n{g.lower()}" for g in 'ABCDF')} FROM {src} GROUP BY {keys}),
   {out}1 AS (SELECT *, (na + nb + nc) * 1.0 / n AS uf, CASE WHEN na = n THEN 1 WHEN na + nb + nc + nd = 0 THEN 5
      WHEN nd >= greatest(na, nb, nc) THEN 4 WHEN nc >= greatest(na, nb) THEN 3 ELSE 2 END AS rk FROM {out}0),
   {out} AS (SELECT *, substr('ABCDF', CAST(CASE WHEN uf < 0.5 THEN greatest(rk, 4) WHEN uf < 0.7 THEN greatest(rk, 3) ELSE rk END AS INTEGER), 1) AS overall FROM {out}1)"""


@query("grd_assess_years", "GRD-01 GRD-02 GRD-04", f"""WITH {ASSESS} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, grade, peak_ratio, correlation AS clim_correlation,
  nrmse AS clim_nrmse, amplitude_ratio, event_response_rate, max_pq_correlation, flashiness_index, completeness, variance_ratio,
  array_to_string(flags, ',') AS flag_codes, CAST(len(flags) AS INTEGER) AS n_flags, CAST(cr AS INTEGER) AS n_critical_flags, CAST(mj AS INTEGER) AS n_major_flags FROM yr""",
  "peak_ratio clim_correlation clim_nrmse amplitude_ratio event_response_rate max_pq_correlation flashiness_index completeness variance_ratio")
def grd_assess_years(spark, sf):
    return G.year_table(G.assess(daily(spark, sf), threshold=WET))


@query("grd_assess_snow_aware", "GRD-02")
def grd_assess_snow_aware(spark, sf):
    return G.year_table(G.assess(daily(spark, sf), threshold=100.0, snow_aware=True))


# The supplier network has many sparse series: its years are graded with looser completeness so
# that every grade occurs.
def supplier_years(spark, sf):
    d = T.supplier_flow(spark, sf)
    dq = Q.data_quality(d)
    flags = Q.climatology_flags(Q.year_deviation(d), min_correlation=0.42, critical_correlation=0.3, max_nrmse=0.9, max_amplitude=0.98)
    k = ["series_id", "hydro_year"]
    ev = dq.select(*k, F.least(F.lit(1.0), F.col("completeness") * 4.3).alias("completeness")).join(flags, k, "left")
    return G.grade_years(ev.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))))


SUPY = f"""{SUP}, {DQ}, {DEV}, b0 AS (SELECT series_id, hy, least(1.0, dq.completeness * 4.3) AS completeness,
   coalesce(CASE WHEN dev.n_days IS NOT NULL THEN {clim_flags(0.42, 0.3, 0.9, 0.3, 0.98)} END, []) AS flags
   FROM dq LEFT JOIN dev USING (series_id, hy)), {grade_cte('b0', 'yr')}"""


@query("grd_year_grades", "GRD-01 FLT-09", f"""WITH {SUPY} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, completeness, array_to_string(flags, ',') AS flags, grade FROM yr""", "completeness")
def grd_year_grades(spark, sf):
    return supplier_years(spark, sf)


@query("grd_series_grades", "GRD-03", f"""WITH {SUPY}, {overall_cte('yr', 'ov')},
  ex AS (SELECT series_id, string_agg(CAST(hy AS VARCHAR), ',' ORDER BY hy) AS x FROM yr WHERE grade = 'F' GROUP BY 1)
  SELECT series_id, n AS n_years_total, na + nb + nc AS n_years_usable, na AS n_years_excellent, nb AS n_years_good, nd AS n_years_poor, nf AS n_years_fail,
   coalesce(x, '') AS excluded_years, uf AS usable_fraction, overall AS overall_grade,
   CASE WHEN overall IN ('A', 'B') AND uf >= 0.8 THEN 'Include' WHEN overall = 'C' OR uf >= 0.5 THEN 'Use with caution' ELSE 'Exclude' END AS recommendation,
   CASE WHEN (overall IN ('A', 'B') AND uf >= 0.8) OR overall = 'C' OR uf >= 0.5 THEN 'decent' ELSE 'poor' END AS new_tier FROM ov LEFT JOIN ex USING (series_id)""",
  "usable_fraction")
def grd_series_grades(spark, sf):
    return G.series_grades(supplier_years(spark, sf))


@query("grd_attach_grades", "GRD-05", f"""WITH {SUPY}, w AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM o)
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, date, w.value, p, grade FROM w LEFT JOIN yr USING (series_id, hy) WHERE n >= 100""", "value p", "date")
def grd_attach_grades(spark, sf):
    return G.attach_grades(T.supplier_flow(spark, sf), supplier_years(spark, sf), min_values=100)


@query("grd_coverage_summary", "GRD-06", f"""WITH {SUPY}, {overall_cte('yr', 'ov')}
  SELECT series_id, hd AS has_discharge, hl AS has_level, fc AS full_coverage, overall AS overall_grade FROM
  (SELECT series_id, count(value) > 0 AS hd, count(p) > 0 AS hl, count(value) = count(*) AND count(*) >= 450 AS fc FROM d GROUP BY 1) JOIN ov USING (series_id)""")
def grd_coverage_summary(spark, sf):
    g = G.series_grades(supplier_years(spark, sf))
    return G.coverage_summary(T.supplier_flow(spark, sf), g, level="p", full_days=450)


@query("grd_year_modes", "GRD-07", f"""WITH {SUPY}, x AS (SELECT o.series_id, year(date) AS cy, hy, grade FROM o JOIN yr USING (series_id, hy)),
   c AS (SELECT series_id, hy, grade, count(*) AS n FROM x GROUP BY 1, 2, 3)
  SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, grade FROM (SELECT *, row_number() OVER (PARTITION BY series_id, hy ORDER BY n DESC, grade) AS r FROM c) WHERE r = 1""")
def grd_year_modes(spark, sf):
    d = T.supplier_flow(spark, sf)
    return G.year_grade_modes(G.attach_grades(d, supplier_years(spark, sf), min_values=1).drop("hydro_year"))


@query("grd_grade_matrix", "GRD-07", f"""WITH {SUPY} SELECT series_id, {', '.join(f"max(grade) FILTER (WHERE hy = {y}) AS y{y}" for y in range(1995, 2003))} FROM yr GROUP BY 1""")
def grd_grade_matrix(spark, sf):
    m = G.grade_matrix(supplier_years(spark, sf), 1995, 2002)
    return m.select("series_id", *[F.col(str(y)).alias(f"y{y}") for y in range(1995, 2003)])


@query("grd_grade_counts", "GRD-07", f"""WITH {SUPY}, {overall_cte('yr', 'ov')} SELECT series_id, n AS n_years, na AS "n_A", nb AS "n_B", nc AS "n_C", nd AS "n_D", nf AS "n_F", wg AS worst_grade, overall AS overall_grade,
  CASE WHEN overall IN ('A', 'B') AND uf >= 0.8 THEN 'Include' WHEN overall = 'C' OR uf >= 0.5 THEN 'Use with caution' ELSE 'Exclude' END AS recommendation
  FROM ov JOIN (SELECT series_id, max(grade) AS wg FROM yr GROUP BY 1) USING (series_id)""")
def grd_grade_counts(spark, sf):
    y = supplier_years(spark, sf)
    return G.grade_counts(y, G.series_grades(y))


@query("grd_parity", "GRD-08", f"""WITH {SUPY}, a AS (SELECT series_id, hy, grade FROM yr), b AS (SELECT series_id, hy, grade FROM yr WHERE grade <> 'F')
  SELECT count(a.grade) AS n_assessed, count(b.grade) AS n_expected, count(*) FILTER (WHERE a.grade = b.grade) AS n_equal,
   count(*) FILTER (WHERE a.grade IS DISTINCT FROM b.grade) AS n_mismatch FROM a FULL JOIN b USING (series_id, hy)""")
def grd_parity(spark, sf):
    y = supplier_years(spark, sf)
    return G.grade_parity(y, y.where("grade <> 'F'"))


@query("grd_flag_census", "GRD-09", f"""WITH {SUPY} SELECT flag, count(*) AS n_years, (SELECT count(*) FROM yr) AS n_assessed_years, count(*) * 100.0 / (SELECT count(*) FROM yr) AS share_pct
  FROM (SELECT unnest(flags) AS flag FROM yr) GROUP BY 1""", "share_pct")
def grd_flag_census(spark, sf):
    years = supplier_years(spark, sf)
    return G.flag_census(G.split_codes(G.year_table(years)))


ACCT = "JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS series_id, s_acctbal FROM supplier) s USING (series_id)"
EDGES, LABELS = (-2000.0, 2000.0, 4000.0, 6000.0, 10000.0), ("to 2000", "2000-4000", "4000-6000", "over 6000")


def site_attr(spark, sf):
    return T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"), "s_acctbal")


@query("grd_grade_by_band", "GRD-10", f"""WITH {SUPY}, {overall_cte('yr', 'ov')}
  SELECT CASE WHEN s_acctbal <= 2000 THEN 'to 2000' WHEN s_acctbal <= 4000 THEN '2000-4000' WHEN s_acctbal <= 6000 THEN '4000-6000' ELSE 'over 6000' END AS band,
   count(*) AS n, avg(CASE WHEN overall = 'A' THEN 100.0 ELSE 0 END) AS pct_a, avg(CASE WHEN overall = 'B' THEN 100.0 ELSE 0 END) AS pct_b,
   avg(CASE WHEN overall IN ('D', 'F') THEN 100.0 ELSE 0 END) AS pct_df FROM ov {ACCT} GROUP BY 1""", "pct_a pct_b pct_df")
def grd_grade_by_band(spark, sf):
    g = G.series_grades(supplier_years(spark, sf)).join(site_attr(spark, sf), "series_id")
    return G.grade_by_band(g, "s_acctbal", EDGES, LABELS)


@query("grd_counterfactual", "GRD-11", f"""WITH {SUPY}, v AS (SELECT series_id, hy, completeness, 'base' AS variant, flags FROM yr UNION ALL
   SELECT series_id, hy, completeness, 'clim', list_filter(flags, lambda x: x NOT IN ('low_clim_correlation', 'very_low_clim_correlation', 'high_clim_nrmse', 'low_amplitude', 'high_amplitude', 'no_seasonal_signal')) FROM yr UNION ALL
   SELECT series_id, hy, completeness, 'pq', list_filter(flags, lambda x: x NOT IN ('very_low_pq_correlation', 'low_pq_correlation')) FROM yr),
   {grade_cte('v', 'vy')}, {overall_cte('vy', 'ov', 'series_id, variant')}
  SELECT variant, overall AS overall_grade, count(*) AS n_series FROM ov GROUP BY 1, 2""")
def grd_counterfactual(spark, sf):
    return G.counterfactual(supplier_years(spark, sf), {"clim": G.CLIMATOLOGY_FAMILY, "pq": G.PQ_FAMILY})


def seasonal_years(spark, sf):
    """Supplier years whose only flag source is the seasonal-signal test."""
    d = T.supplier_flow(spark, sf)
    k = ["series_id", "hydro_year"]
    flat = Q.flat_years(d, relative_threshold=0.8, min_regime_peak_ratio=1.5)
    f = F.when(F.coalesce("is_flat", F.lit(False)), F.array(F.lit("no_seasonal_signal"))).otherwise(F.array().cast("array<string>"))
    ev = Q.data_quality(d).select(*k, F.least(F.lit(1.0), F.col("completeness") * 4.0).alias("completeness")).join(flat, k, "left")
    return G.grade_years(ev.select(*k, "completeness", f.alias("flags")))


@query("grd_completeness_bar", "GRD-12", f"""WITH {SUP}, {DQ}, {PEAK(m=1.5, rel=0.8)},
  b0 AS (SELECT series_id, hy, least(1.0, completeness * 4.0) AS completeness, CASE WHEN coalesce(is_flat, false) THEN ['no_seasonal_signal'] ELSE [] END AS flags FROM dq LEFT JOIN fl USING (series_id, hy)),
  {grade_cte('b0', 'y1')}, b1 AS (SELECT series_id, hy, grade AS g1, completeness, flags AS f1, CASE WHEN completeness < 0.85 THEN list_filter(flags, lambda x: x <> 'no_seasonal_signal') ELSE flags END AS flags FROM y1),
  {grade_cte('b1', 'y2')}, {overall_cte('y2', 'oa', grade='g1')}, {overall_cte('y2', 'ob')}
  SELECT (SELECT count(*) FROM y2 WHERE g1 = 'F') AS n_fail_years, (SELECT count(*) FROM y2 WHERE g1 = 'F' AND len(f1) > 0 AND completeness >= 0.5 AND completeness < 0.85) AS n_suppressed_years,
   count(*) FILTER (WHERE oa.overall <> ob.overall) AS n_changed_series FROM oa JOIN ob USING (series_id)""")
def grd_completeness_bar(spark, sf):
    return G.completeness_bar(seasonal_years(spark, sf))


@query("grd_grade_contrast", "GRD-13", f"""WITH {SUPY}, {overall_cte('yr', 'ov')}, m AS (SELECT series_id, avg(value) AS q_mean, max(value) AS q_max FROM o GROUP BY 1),
  l AS (SELECT series_id, CASE WHEN overall = 'B' THEN 'B' ELSE 'rest' END AS "group", metric, v FROM (UNPIVOT (SELECT series_id, overall, q_mean, q_max FROM m JOIN ov USING (series_id)) ON q_mean, q_max INTO NAME metric VALUE v))
  SELECT "group", metric, count(*) AS n, quantile_cont(v, 0.25) AS q25, median(v) AS median, quantile_cont(v, 0.75) AS q75 FROM l GROUP BY 1, 2""".replace("overall = 'B' THEN 'B'", "overall = 'A' THEN 'A'"), "q25 median q75")
def grd_grade_contrast(spark, sf):
    m = T.supplier_flow(spark, sf).groupBy("series_id").agg(F.avg("value").alias("q_mean"), F.max("value").alias("q_max"))
    return G.grade_contrast(m.join(G.series_grades(supplier_years(spark, sf)), "series_id"), ["q_mean", "q_max"])


@query("grd_reliability", "GRD-14", f"""WITH {SUPY} SELECT CAST(s_suppkey AS VARCHAR) AS series_id, coalesce(n_assessed, 0) AS n_assessed, pct_a FROM supplier
  LEFT JOIN (SELECT series_id, count(grade) AS n_assessed, count(*) FILTER (WHERE grade = 'A') * 100.0 / count(grade) AS pct_a FROM yr GROUP BY 1) y ON y.series_id = CAST(s_suppkey AS VARCHAR)""", "pct_a")
def grd_reliability(spark, sf):
    return G.reliability(site_attr(spark, sf), supplier_years(spark, sf))


@query("grd_grade_profile", "GRD-15", f"""WITH {SUPY}, {overall_cte('yr', 'ov')}, p1 AS (SELECT series_id, count(*) / 365.25 AS years, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv,
   (1 - count(value) * 1.0 / count(*)) * 100 AS missing_pct FROM d GROUP BY 1)
  SELECT overall AS overall_grade, count(*) AS n, {', '.join(f"avg({c}) AS {c}_mean, median({c}) AS {c}_median" for c in ('years', 'mean', 'cv', 'missing_pct'))}
  FROM p1 JOIN ov USING (series_id) GROUP BY 1""", " ".join(f"{c}_{x}" for c in ("years", "mean", "cv", "missing_pct") for x in ("mean", "median")))
def grd_grade_profile(spark, sf):
    return G.grade_profile(T.supplier_flow(spark, sf), G.series_grades(supplier_years(spark, sf)))
