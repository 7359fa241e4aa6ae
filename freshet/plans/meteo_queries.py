"""Queries for temperature, extremes, seasons, climate classes and gridded fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as GR
from ..operators import ingest as IN
from ..operators import meteo as M
from ..operators import spatial as SP
from ..sources import tables as T
from .registry import REGISTRY, query

TD = T.FORCING_SQL + ", d AS (SELECT series_id, date, t AS value, p_a AS p, t FROM forcing)"
SEA = "CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Spring' WHEN month(date) <= 8 THEN 'Summer' ELSE 'Autumn' END"


def temp(spark, sf):
    return T.forcing(spark, sf).select("series_id", "date", F.col("t").alias("value"))


# Row runs of a condition on d: one row per run.
def runs(cond: str, out: str, src: str = "d") -> str:
    return f"""{out}f AS (SELECT *, coalesce({cond}, false) AS f FROM {src}), {out}g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - row_number() OVER (PARTITION BY series_id, f ORDER BY date) AS g FROM {out}f),
     {out} AS (SELECT series_id, g, min(date) AS "start", max(date) AS "end", count(*) AS n, avg(value) AS im, min(value) AS ii, max(value) AS ix FROM {out}g WHERE f GROUP BY 1, 2)"""


@query("met_basic_statistics", "MET-12", f"""WITH {TD} SELECT series_id, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, count(value) AS "count", count(*) - count(value) AS missing_count FROM d GROUP BY 1""", "mean std min max median q25 q75")
def met_basic_statistics(spark, sf):
    return M.basic_statistics(temp(spark, sf))


@query("met_annual_statistics", "MET-13", f"""WITH {TD} SELECT series_id, CAST(year(date) AS INTEGER) AS year, round(avg(value), 2) AS mean, round(min(value), 2) AS min, round(max(value), 2) AS max, round(stddev_samp(value), 2) AS std,
  count(value) AS "count", round(quantile_cont(value, 0.1), 2) AS q10, round(quantile_cont(value, 0.9), 2) AS q90 FROM d GROUP BY 1, 2""", "mean min max std q10 q90")
def met_annual_statistics(spark, sf):
    return M.annual_statistics(temp(spark, sf))


@query("met_seasonal_statistics", "MET-14", f"""WITH {TD} SELECT series_id, CAST(year(date) AS INTEGER) AS year, {SEA} AS season, avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_samp(value) AS std FROM d GROUP BY 1, 2, 3""", "mean min max std")
def met_seasonal_statistics(spark, sf):
    return M.seasonal_statistics(temp(spark, sf))


def _ext(cold, hot):
    return f"""WITH {TD}, {runs(f'value <= {cold}', 'rc')}, {runs(f'value >= {hot}', 'rh')}
  SELECT series_id, count(*) FILTER (WHERE value <= {cold}) AS cold_days_count, count(*) FILTER (WHERE value >= {hot}) AS hot_days_count, count(*) FILTER (WHERE value <= {cold}) * 100.0 / count(*) AS cold_days_percentage,
   count(*) FILTER (WHERE value >= {hot}) * 100.0 / count(*) AS hot_days_percentage, coalesce((SELECT max(n) FROM rc WHERE rc.series_id = d.series_id), 0) AS max_consecutive_cold,
   coalesce((SELECT max(n) FROM rh WHERE rh.series_id = d.series_id), 0) AS max_consecutive_hot, (SELECT min(b.date) FROM d b WHERE b.series_id = d.series_id AND b.value = min(d.value)) AS coldest_date, min(value) AS coldest,
   (SELECT min(b.date) FROM d b WHERE b.series_id = d.series_id AND b.value = max(d.value)) AS hottest_date, max(value) AS hottest FROM d GROUP BY series_id"""


@query("met_temperature_extremes", "MET-15", _ext(-10.0, 10.0), "cold_days_percentage hot_days_percentage coldest hottest", "coldest_date hottest_date")
def met_temperature_extremes(spark, sf):
    return M.temperature_extremes(temp(spark, sf), cold=-10.0, hot=10.0)


@query("met_degree_days", "MET-16", f"""WITH {TD} SELECT series_id, CAST(year(date) AS INTEGER) AS year, sum(greatest(value - 10, 0)) AS annual_gdd, sum(greatest(10 - value, 0)) AS annual_hdd FROM d GROUP BY 1, 2""", "annual_gdd annual_hdd")
def met_degree_days(spark, sf):
    return M.annual_degree_days(temp(spark, sf))


@query("met_frost_years", "MET-17", f"""WITH {TD} SELECT series_id, CAST(year(date) AS INTEGER) AS year, min(date) AS first_frost, max(date) AS last_frost, count(*) AS frost_days FROM d WHERE value <= 0 GROUP BY 1, 2""", "", "first_frost last_frost")
def met_frost_years(spark, sf):
    return M.frost_years(temp(spark, sf))


@query("met_frost_summary", "MET-17", f"""WITH {TD}, y AS (SELECT series_id, year(date) AS y, count(*) FILTER (WHERE value <= 0) AS f, count(*) AS n FROM d GROUP BY 1, 2)
  SELECT series_id, CAST(sum(f) AS BIGINT) AS total_frost_days, sum(f) * 100.0 / sum(n) AS frost_percentage, coalesce(avg(f) FILTER (WHERE f > 0), 0) AS average_frost_days_per_year FROM y GROUP BY 1""", "frost_percentage average_frost_days_per_year")
def met_frost_summary(spark, sf):
    return M.frost_summary(temp(spark, sf))


@query("met_temperature_metrics", "MET-18")
def met_temperature_metrics(spark, sf):
    return M.temperature_metrics(temp(spark, sf))


@query("met_percentile_thresholds", "MET-19", f"WITH {TD} SELECT series_id, quantile_cont(value, 0.1) AS low_threshold, quantile_cont(value, 0.9) AS high_threshold FROM d GROUP BY 1", "low_threshold high_threshold")
def met_percentile_thresholds(spark, sf):
    return M.percentile_thresholds(temp(spark, sf))


_EV = """SELECT series_id, '{k}' AS kind, "start", "end", {dur} AS duration_days, im AS intensity_mean, ii AS intensity_min, ix AS intensity_max FROM {t}""".format
_THR = f"{TD}, dt AS (SELECT *, quantile_cont(value, 0.1) OVER (PARTITION BY series_id) AS lo, quantile_cont(value, 0.9) OVER (PARTITION BY series_id) AS hi FROM d), {runs('value <= lo', 'rl', 'dt')}, {runs('value >= hi', 'rh', 'dt')}"
_DD = """date_diff('day', "start", "end") + 1"""


@query("met_extreme_periods", "MET-20", f"WITH {_THR} {_EV(k='low', dur=_DD, t='rl')} UNION ALL {_EV(k='high', dur=_DD, t='rh')}", "intensity_mean intensity_min intensity_max", '"start" "end"')
def met_extreme_periods(spark, sf):
    return M.extreme_periods(temp(spark, sf))


@query("met_extreme_shares", "MET-20", f"""WITH {_THR} SELECT series_id, max(lo) AS low_threshold, max(hi) AS high_threshold, count(*) FILTER (WHERE value <= lo) AS extreme_low_count, count(*) FILTER (WHERE value >= hi) AS extreme_high_count,
  count(*) FILTER (WHERE value <= lo) * 100.0 / count(*) AS extreme_low_percentage, count(*) FILTER (WHERE value >= hi) * 100.0 / count(*) AS extreme_high_percentage FROM dt GROUP BY 1""", "low_threshold high_threshold extreme_low_percentage extreme_high_percentage")
def met_extreme_shares(spark, sf):
    return M.extreme_shares(temp(spark, sf))


def _spell(cond, peak):
    return f"""WITH {TD}, {runs(cond, 'r')}, s AS (SELECT series_id, count(*) AS k, sum(n) AS td, avg(n) AS ad, max(n) AS md, {peak} AS pk FROM r WHERE n >= 3 GROUP BY 1)
  SELECT series_id, coalesce(k, 0) AS n_events, CAST(coalesce(td, 0) AS BIGINT) AS total_days, coalesce(ad, 0) AS average_duration, coalesce(md, 0) AS maximum_duration, coalesce(pk, 0) AS peak_intensity FROM (SELECT DISTINCT series_id FROM d) LEFT JOIN s USING (series_id)"""


@query("met_heat_waves", "MET-21", _spell("value >= 5", "max(ix)"), "average_duration peak_intensity")
def met_heat_waves(spark, sf):
    return M.spell_summary(temp(spark, sf), threshold=5.0)


@query("met_cold_spells", "MET-21", _spell("value <= -4", "min(ii)"), "average_duration peak_intensity")
def met_cold_spells(spark, sf):
    return M.spell_summary(temp(spark, sf), threshold=-4.0, hot=False)


@query("met_annual_extremes", "MET-22", f"""WITH {TD} SELECT series_id, CAST(year(date) AS INTEGER) AS year, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM d GROUP BY 1, 2""", "min max mean std p01 p99")
def met_annual_extremes(spark, sf):
    return M.annual_extremes(temp(spark, sf))


@query("met_extreme_events", "MET-23", f"""WITH {_THR}, {runs('value >= 5', 'rw')}, {runs('value <= -4', 'rs')} {_EV(k='low', dur=_DD, t='rl')} UNION ALL {_EV(k='high', dur=_DD, t='rh')}
  UNION ALL {_EV(k='heat_wave', dur='n', t='rw')} WHERE n >= 3 UNION ALL {_EV(k='cold_spell', dur='n', t='rs')} WHERE n >= 3""", "intensity_mean intensity_min intensity_max", '"start" "end"')
def met_extreme_events(spark, sf):
    return M.extreme_event_table(temp(spark, sf), heat=5.0, cold=-4.0)


_S4 = [s.lower() for s in M.SEASONS]


@query("met_season_table", "MET-24", f"""WITH {TD} SELECT series_id, CAST(year(date) AS INTEGER) AS year, {', '.join(f"{fn}(value) FILTER (WHERE {SEA} = '{s}') AS {s.lower()}_{n}" for s in M.SEASONS for fn, n in (('avg', 'mean'), ('sum', 'total'), ('min', 'min'), ('max', 'max')))} FROM d GROUP BY 1, 2""",
  " ".join(f"{s}_{n}" for s in _S4 for n in ("mean", "total", "min", "max")))
def met_season_table(spark, sf):
    return M.season_table(temp(spark, sf))


@query("met_monthly_climatology", "MET-25", f"WITH {TD} SELECT series_id, CAST(month(date) AS INTEGER) AS month, avg(value) AS mean FROM d WHERE year(date) BETWEEN 1996 AND 1999 GROUP BY 1, 2", "mean")
def met_monthly_climatology(spark, sf):
    return M.monthly_climatology(temp(spark, sf), years=(1996, 1999))


@query("met_seasonal_anomalies", "MET-26", f"""WITH {TD}, c AS (SELECT series_id, {SEA} AS season, avg(value) AS c FROM d WHERE year(date) BETWEEN 1996 AND 1999 GROUP BY 1, 2),
  y AS (SELECT series_id, {SEA} AS season, year(date) AS y, avg(value) AS m FROM d GROUP BY 1, 2, 3) SELECT series_id, season, CAST(y AS INTEGER) AS year, m - c AS anomaly FROM y LEFT JOIN c USING (series_id, season)""", "anomaly")
def met_seasonal_anomalies(spark, sf):
    return M.seasonal_anomalies(temp(spark, sf), years=(1996, 1999))


@query("met_annual_cycle", "MET-27", f"""WITH {TD}, m AS (SELECT series_id, CAST(month(date) AS INTEGER) AS m, round(avg(value), 2) AS v FROM d GROUP BY 1, 2),
  a AS (SELECT series_id, avg(v) AS annual_mean, max(v) - min(v) AS annual_range, stddev_samp(v) / avg(v) * 100 AS coefficient_of_variation, avg(v * cos(2 * pi() * (m - 1) / 12)) * 2 AS a, avg(v * sin(2 * pi() * (m - 1) / 12)) * 2 AS b, max(v) AS hi, min(v) AS lo FROM m GROUP BY 1)
  SELECT series_id, annual_mean, annual_range, (SELECT min(m) FROM m WHERE m.series_id = a.series_id AND v = hi) AS max_month, (SELECT min(m) FROM m WHERE m.series_id = a.series_id AND v = lo) AS min_month, coefficient_of_variation,
   atan2(b, a) AS phase_radians, sqrt(a * a + b * b) AS annual_amplitude, CASE WHEN atan2(b, a) < 0 THEN atan2(b, a) * 6 / pi() + 12 ELSE atan2(b, a) * 6 / pi() END + 1 AS peak_month_harmonic FROM a""",
  "annual_mean annual_range coefficient_of_variation phase_radians annual_amplitude peak_month_harmonic")
def met_annual_cycle(spark, sf):
    return M.annual_cycle(temp(spark, sf))


@query("met_onset_dates", "MET-28", f"WITH {TD} SELECT series_id, CAST(year(date) AS INTEGER) AS year, min(date) FILTER (WHERE value >= 10) AS onset FROM d GROUP BY 1, 2", "", "onset")
def met_onset_dates(spark, sf):
    return M.onset_dates(temp(spark, sf), 10.0)


@query("met_seasonal_trends", "MET-29", f"""WITH {TD}, y AS (SELECT series_id, {SEA} AS season, year(date) AS y, avg(value) AS m FROM d GROUP BY 1, 2, 3)
  SELECT series_id, season, count(*) AS n_years, regr_slope(m, y) AS slope, regr_intercept(m, y) AS intercept, regr_r2(m, y) AS r_squared, regr_slope(m, y) * 10 AS trend_per_decade FROM y GROUP BY 1, 2 HAVING count(*) >= 3""", "slope intercept r_squared trend_per_decade")
def met_seasonal_trends(spark, sf):
    return M.seasonal_trends(temp(spark, sf)).drop("p_value", "trend_significant")


@query("met_seasonal_trend_tests", "MET-29")
def met_seasonal_trend_tests(spark, sf):
    return M.seasonal_trends(temp(spark, sf))


def _long_sql(part: str, name: str, label: str, year: str) -> str:
    gone = ", ".join(c for c in ("series_id", label, "year" if year != "NULL" else "") if c and c != "''")
    ids = f"series_id, '{part}' AS part, CAST({label} AS VARCHAR) AS label, CAST({year} AS INTEGER) AS year"
    return f"SELECT * FROM (UNPIVOT (SELECT {ids}, COLUMNS(* EXCLUDE ({gone}))::DOUBLE FROM ({REGISTRY[name].sql})) ON COLUMNS(* EXCLUDE (series_id, part, label, year)) INTO NAME statistic VALUE value)"


_PARTS = (("seasons", "met_season_table", "''", "year"), ("climatology", "met_monthly_climatology", "month", "NULL"), ("anomalies", "met_seasonal_anomalies", "season", "year"), ("cycle", "met_annual_cycle", "''", "NULL"), ("trends", "met_seasonal_trends", "season", "NULL"))


@query("met_seasonal_union", "MET-30", " UNION ALL ".join(_long_sql(*p) for p in _PARTS), "value")
def met_seasonal_union(spark, sf):
    """The union of all seasonal parts; p-values have a query of their own."""
    return M.seasonal_union(temp(spark, sf), years=(1996, 1999)).where("statistic <> 'p_value'")


_NORM = """mn0 AS (SELECT series_id, year(date) AS y, CAST(month(date) AS INTEGER) AS month, sum(t) AS st, count(t) AS nt, sum(p) AS p FROM d GROUP BY 1, 2, 3),
  mn AS (SELECT series_id, month, sum(st) / sum(nt) AS t, avg(p) / 50 AS p FROM mn0 GROUP BY 1, 2)"""
_KOP = """six AS (SELECT series_id, month, CAST(round(t + CAST(1.3e-8 AS DOUBLE), 6) AS DECIMAL(18, 6)) AS t, CAST(round(p + CAST(1.3e-8 AS DOUBLE), 6) AS DECIMAL(18, 6)) AS p FROM mn),
  g AS (SELECT series_id, count(t) AS nt, count(p) AS np, CAST(sum(t) AS DOUBLE) / count(t) AS mat, CAST(sum(p) AS DOUBLE) AS map, CAST(max(t) AS DOUBLE) AS thot, CAST(min(t) AS DOUBLE) AS tcold, CAST(min(p) AS DOUBLE) AS pdry, count(*) FILTER (WHERE t > 10) AS m10,
   CAST(sum(t) FILTER (WHERE month BETWEEN 4 AND 9) AS DOUBLE) / count(t) FILTER (WHERE month BETWEEN 4 AND 9) >= CAST(sum(t) FILTER (WHERE month NOT BETWEEN 4 AND 9) AS DOUBLE) / count(t) FILTER (WHERE month NOT BETWEEN 4 AND 9) AS north FROM six GROUP BY 1),
  h AS (SELECT series_id, any_value(mat) AS mat, any_value(map) AS map, any_value(thot) AS thot, any_value(tcold) AS tcold, any_value(pdry) AS pdry, any_value(m10) AS m10, any_value(nt) AS nt, any_value(np) AS np,
    CAST(sum(six.p) FILTER (WHERE s) AS DOUBLE) AS ss, CAST(min(six.p) FILTER (WHERE s) AS DOUBLE) AS smin, CAST(max(six.p) FILTER (WHERE s) AS DOUBLE) AS smax, CAST(sum(six.p) FILTER (WHERE NOT s) AS DOUBLE) AS ws, CAST(min(six.p) FILTER (WHERE NOT s) AS DOUBLE) AS wmin, CAST(max(six.p) FILTER (WHERE NOT s) AS DOUBLE) AS wmax
   FROM (SELECT six.*, (month BETWEEN 4 AND 9) = north AS s FROM six JOIN g USING (series_id)) six JOIN g USING (series_id) GROUP BY 1),
  k AS (SELECT *, 2 * mat + CASE WHEN ws >= 0.7 * map THEN 0 WHEN ss >= 0.7 * map THEN 28 ELSE 14 END AS thr, smin < 40 AND smin < wmax / 3 AS ds, wmin < smax / 10 AS dw FROM h),
  l AS (SELECT *, CASE WHEN ds AND dw THEN CASE WHEN ws > ss THEN 's' ELSE 'w' END WHEN ds THEN 's' WHEN dw THEN 'w' ELSE 'f' END AS rn FROM k)
  SELECT series_id, CASE WHEN nt <> 12 OR np <> 12 THEN '' WHEN map < 10 * thr THEN CASE WHEN map < 5 * thr THEN 'BW' ELSE 'BS' END || CASE WHEN mat >= 18 THEN 'h' ELSE 'k' END
   WHEN tcold >= 18 THEN CASE WHEN pdry >= 60 THEN 'Af' WHEN pdry >= 100 - map / 25 THEN 'Am' ELSE 'Aw' END WHEN thot <= 10 THEN CASE WHEN thot > 0 THEN 'ET' ELSE 'EF' END
   WHEN tcold > 0 THEN 'C' || rn || CASE WHEN thot >= 22 THEN 'a' WHEN m10 >= 4 THEN 'b' ELSE 'c' END ELSE 'D' || rn || CASE WHEN thot >= 22 THEN 'a' WHEN m10 >= 4 THEN 'b' WHEN tcold < -38 THEN 'd' ELSE 'c' END END AS climate_class FROM l"""


@query("met_climate_class", "MET-31 MET-32", f"""WITH {T.SUPPLIER_SQL}, d AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) * 800.0 - 30.0, 6) AS t, sum(l_quantity) AS p FROM lineitem GROUP BY 1, 2), {_NORM.replace('avg(p) / 50', 'avg(p) / 3')}, {_KOP}""")
def met_climate_class(spark, sf):
    d = T.daily_sum(T.table(spark, sf, "lineitem"), F.col("l_suppkey"), F.col("l_shipdate"),
                    t=F.round(F.avg("l_discount") * 800.0 - 30.0, 6), p=F.sum("l_quantity"))
    return M.climate_class(M.monthly_normals(d).withColumn("p", F.col("p") / 3))


@query("met_phase_partition", "MET-33", f"""WITH {TD} SELECT series_id, sum(p) FILTER (WHERE t < 0) / (count(*) / 365.25) AS sub_zero_mm_yr, sum(p) FILTER (WHERE t >= 0) / (count(*) / 365.25) AS above_zero_mm_yr FROM d WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY 1""", "sub_zero_mm_yr above_zero_mm_yr")
def met_phase_partition(spark, sf):
    return M.phase_partition(T.forcing(spark, sf).withColumn("p", F.col("p_a")))


@query("met_annual_precipitation", "MET-34", f"""WITH {TD}, y AS (SELECT series_id, year(date) AS y, avg(p) * count(*) AS a FROM d GROUP BY 1, 2) SELECT series_id, avg(a) AS mean_annual_mm, stddev_samp(a) / avg(a) AS interannual_cv, count(*) AS n_years FROM y GROUP BY 1""", "mean_annual_mm interannual_cv")
def met_annual_precipitation(spark, sf):
    return M.annual_precipitation(T.forcing(spark, sf).withColumn("p", F.col("p_a")))


_PC = "(VALUES ('p_a', p_a), ('p_b', p_b), ('p_c', p_c)) AS v(product, p)"


@query("met_phase_network", "MET-33", f"""WITH {T.FORCING_SQL}, n AS (SELECT (max(date) - min(date) + 1) / 365.25 AS years FROM forcing), l AS (SELECT series_id, date, t, product, p FROM forcing CROSS JOIN LATERAL {_PC}),
  s AS (SELECT series_id, product, coalesce(sum(p) FILTER (WHERE t < 0), 0) AS sub_freezing, coalesce(sum(p) FILTER (WHERE t >= 0), 0) AS above_freezing FROM l GROUP BY 1, 2),
  u AS (UNPIVOT s ON sub_freezing, above_freezing INTO NAME phase VALUE v)
  SELECT product, phase, avg(v) / (SELECT years FROM n) AS mm_per_year FROM u GROUP BY 1, 2""", "mm_per_year")
def met_phase_network(spark, sf):
    return M.phase_network(T.forcing(spark, sf), ["p_a", "p_b", "p_c"])


@query("met_precipitation_table", "MET-34", f"""WITH {T.FORCING_SQL}, l AS (SELECT series_id, date, product, p FROM forcing CROSS JOIN LATERAL {_PC}),
  y AS (SELECT series_id, product, year(date) AS y, avg(p) * count(*) AS a FROM l GROUP BY 1, 2, 3 HAVING count(p) >= 1), m AS (SELECT series_id, product, avg(a) AS mean_mm, stddev_samp(a) / avg(a) AS cv FROM y GROUP BY 1, 2)
  SELECT product, count(mean_mm) AS n_series, 100.0 * count(mean_mm) / (SELECT count(DISTINCT series_id) FROM forcing) AS coverage_pct, avg(mean_mm) AS mean_annual_mm, stddev_samp(mean_mm) AS std_annual_mm, avg(cv) AS mean_cv FROM m GROUP BY 1""", "coverage_pct mean_annual_mm std_annual_mm mean_cv")
def met_precipitation_table(spark, sf):
    return M.precipitation_table(T.forcing(spark, sf), ["p_a", "p_b", "p_c"])


@query("met_product_agreement", "MET-35", f"""WITH {T.FORCING_SQL}, l AS (SELECT series_id, pair, x, y FROM forcing CROSS JOIN LATERAL (VALUES ('p_a-p_b', p_a, p_b), ('p_a-p_c', p_a, p_c), ('p_b-p_c', p_b, p_c)) AS v(pair, x, y) WHERE x IS NOT NULL AND y IS NOT NULL)
  SELECT series_id, pair, count(*) AS n_days, corr(x, y) AS r, avg(x - y) AS mean_bias FROM l GROUP BY 1, 2 HAVING count(*) >= 365""", "r mean_bias")
def met_product_agreement(spark, sf):
    return M.product_agreement(T.forcing(spark, sf), [("p_a", "p_b"), ("p_a", "p_c"), ("p_b", "p_c")])


@query("met_product_shares", "MET-36", f"""WITH {T.SUPPLIER_SQL}, {T.SITES_SQL}, m AS (SELECT series_id, avg(value) AS a, avg(p) / 1.5 AS b FROM sup GROUP BY 1)
  SELECT CASE WHEN lon < 31 THEN 'west' ELSE 'east' END AS region, count(*) AS n, avg(a - b) AS mean_difference, avg(CASE WHEN a > b THEN 100.0 ELSE 0 END) AS pct_first_larger FROM m JOIN sites USING (series_id) GROUP BY 1""", "mean_difference pct_first_larger")
def met_product_shares(spark, sf):
    m = T.supplier_flow(spark, sf).groupBy("series_id").agg(F.avg("value").alias("a"), (F.avg("p") / 1.5).alias("b"))
    m = m.join(T.sites(spark, sf), "series_id")
    return M.product_shares(m, "a", "b", F.when(F.col("lon") < 31, "west").otherwise("east"))


@query("met_season_means", "MET-37", f"""WITH {TD} SELECT series_id, avg(value) AS mean, avg(value) FILTER (WHERE month(date) IN (12, 1, 2)) AS djf, avg(value) FILTER (WHERE month(date) BETWEEN 3 AND 5) AS mam,
  avg(value) FILTER (WHERE month(date) BETWEEN 6 AND 8) AS jja, avg(value) FILTER (WHERE month(date) BETWEEN 9 AND 11) AS son FROM d GROUP BY 1""", "mean djf mam jja son")
def met_season_means(spark, sf):
    return M.season_means(temp(spark, sf))


# ---- gridded fields ----


def two_places(df, *columns):
    """Daily catchment means are reported to two places; overlap areas carry about nine digits."""
    return df.withColumns({c: F.round(c, 2) for c in columns})


def area_sql(src: str, keys: str, out: str) -> str:
    """Spherical ring areas from (keys, seq, lon, lat)."""
    return f"""{out}0 AS (SELECT {keys}, seq, 2 * atan2(sqrt(h), sqrt(1 - h)) AS c, atan2(cos(la) * sin(lo), sin(la)) AS az FROM (SELECT *, sin(la / 2) ** 2 + cos(la) * sin(lo / 2) ** 2 AS h FROM (SELECT {keys}, seq, radians(lat) AS la, radians(lon) AS lo FROM {src}))),
    {out}1 AS (SELECT *, coalesce(lead(c) OVER w, first_value(c) OVER w) AS c2, coalesce(lead(az) OVER w, first_value(az) OVER w) AS az2 FROM {out}0 WINDOW w AS (PARTITION BY {keys} ORDER BY seq)),
    {out}2 AS (SELECT {keys}, abs(sum((1 - cos((c + c2) / 2)) * (az2 - az - 2 * pi() * floor((az2 - az + pi()) / (2 * pi()))))) / (4 * pi()) AS e FROM {out}1 GROUP BY {keys}),
    {out} AS (SELECT {keys}, least(e, 1 - e) * 4 * pi() * CAST(6378137.0 AS DOUBLE) ** 2 / 1e6 AS area_km2 FROM {out}2)"""


EXT = """ex0 AS (SELECT series_id AS poly_id, CAST(floor((lon - r) / 0.1 + 0.5) AS BIGINT) AS x1, CAST(floor((lon + r) / 0.1 + 0.5) AS BIGINT) AS x2, CAST(floor((lat + r * -0.5) / 0.1 + 0.5) AS BIGINT) AS y1, CAST(floor((lat + r * 0.5) / 0.1 + 0.5) AS BIGINT) AS y2, lon - r AS a1, lon + r AS a2, lat + r * -0.5 AS b1, lat + r * 0.5 AS b2 FROM sites),
  ex AS (SELECT poly_id, x1 - CASE WHEN x2 - x1 <= 2 THEN 1 ELSE 0 END AS x1, x2 + CASE WHEN x2 - x1 <= 2 THEN 1 ELSE 0 END AS x2, y1 - CASE WHEN y2 - y1 <= 2 THEN 1 ELSE 0 END AS y1, y2 + CASE WHEN y2 - y1 <= 2 THEN 1 ELSE 0 END AS y2, a1, a2, b1, b2 FROM ex0),
  gc AS (SELECT DISTINCT lat, lon, CAST(floor(lon / 0.1 + 0.5) AS BIGINT) AS kx, CAST(floor(lat / 0.1 + 0.5) AS BIGINT) AS ky FROM field),
  pc AS (SELECT poly_id, lat, lon, a1, a2, b1, b2 FROM ex JOIN gc ON kx BETWEEN x1 AND x2 AND ky BETWEEN y1 AND y2)"""
WGT = f"""ov AS (SELECT poly_id, lat AS clat, lon AS clon, greatest(a1, lon - 0.05) AS u1, least(a2, lon + 0.05) AS u2, greatest(b1, lat - 0.05) AS v1, least(b2, lat + 0.05) AS v2 FROM pc),
  oc AS (SELECT poly_id, clat, clon, seq, CASE WHEN seq IN (0, 3) THEN u1 ELSE u2 END AS lon, CASE WHEN seq < 2 THEN v1 ELSE v2 END AS lat FROM ov CROSS JOIN (SELECT unnest(range(4)) AS seq) WHERE u2 > u1 AND v2 > v1),
  {area_sql('oc', 'poly_id, clat, clon', 'oa')},
  wt AS (SELECT poly_id, clat AS lat, clon AS lon, area_km2 / sum(area_km2) OVER (PARTITION BY poly_id) AS w FROM oa WHERE area_km2 > 0)"""


@query("met_cell_extents", "MET-09", f"WITH {T.SITES_SQL}, {T.FIELD_SQL}, {EXT} SELECT poly_id, lat, lon FROM pc", "lat lon")
def met_cell_extents(spark, sf):
    return GR.cells_in_extent(T.boxes(spark, sf), T.field_cells(spark, sf), 0.1)


HOLED = f"""rg AS (SELECT * FROM (VALUES (1, 1, -1.0, 1.0, 0.5), (2, -1, -0.5, 0.5, 0.25), (3, 1, 1.5, 2.5, 0.25)) AS v(k, sign, dx1, dx2, h)),
  gc AS (SELECT DISTINCT lat, lon FROM field),
  ov AS (SELECT series_id AS poly_id, k, sign, g.lat AS clat, g.lon AS clon, greatest(s.lon + s.r * dx1, g.lon - 0.05) AS u1, least(s.lon + s.r * dx2, g.lon + 0.05) AS u2, greatest(s.lat - s.r * h, g.lat - 0.05) AS v1, least(s.lat + s.r * h, g.lat + 0.05) AS v2
    FROM sites s JOIN gc g ON g.lon BETWEEN s.lon - s.r - 0.1 AND s.lon + 2.5 * s.r + 0.1 AND g.lat BETWEEN s.lat - s.r - 0.1 AND s.lat + s.r + 0.1 CROSS JOIN rg),
  oc AS (SELECT poly_id, k, sign, clat, clon, seq, CASE WHEN seq IN (0, 3) THEN u1 ELSE u2 END AS lon, CASE WHEN seq < 2 THEN v1 ELSE v2 END AS lat FROM ov CROSS JOIN (SELECT unnest(range(4)) AS seq) WHERE u2 > u1 AND v2 > v1),
  {area_sql('oc', 'poly_id, k, sign, clat, clon', 'oa')},
  os AS (SELECT poly_id, clat AS lat, clon AS lon, sum(sign * area_km2) AS a FROM oa GROUP BY 1, 2, 3)"""


@query("met_fractional_weights", "MET-02", f"WITH {T.SITES_SQL}, {T.FIELD_SQL}, {HOLED} SELECT poly_id, lat, lon, a / sum(a) OVER (PARTITION BY poly_id) AS w FROM os WHERE a > 1e-9", "lat lon w")
def met_fractional_weights(spark, sf):
    """Catchments of two parts, one of them with a hole."""
    return GR.fractional_weights(T.holed_boxes(spark, sf), T.field_cells(spark, sf), 0.1)


@query("met_weighted_means", "MET-01 MET-03 MET-06", f"""WITH {T.SITES_SQL}, {T.FIELD_SQL}, {EXT}, {WGT}
  SELECT poly_id, date, round(greatest(sum(prcp * w) / sum(w), 0), 2) AS prcp, round(sum(t * w) / sum(w), 2) AS t FROM field JOIN wt USING (lat, lon) GROUP BY 1, 2""", "prcp t", "date")
def met_weighted_means(spark, sf):
    f = T.field(spark, sf)
    w = GR.fractional_weights(T.boxes(spark, sf), T.field_cells(spark, sf), 0.1)
    return two_places(GR.catchment_means(f, w, ["prcp", "t"]), "prcp", "t")


@query("met_monthly_by_rule", "MET-10", f"""WITH {T.FIELD_SQL}, fm AS (SELECT lat, lon, year(date) AS year, month(date) AS month, prcp, t, prcp AS runoff FROM field)
  SELECT lat, lon, year, month, sum(prcp) AS prcp, avg(t) AS t, sum(runoff) AS runoff FROM fm GROUP BY 1, 2, 3, 4""", "lat lon prcp t runoff")
def met_monthly_by_rule(spark, sf):
    """Months of every cell: water by its name and runoff as a totals product are summed, temperature is averaged."""
    f = T.field(spark, sf).withColumn("year", F.year("date")).withColumn("month", F.month("date")).withColumn("runoff", F.col("prcp"))
    return GR.aggregate_by_rule(f, ["prcp", "t", "runoff"], ["lat", "lon", "year", "month"], totals=["runoff"])


@query("met_touched_means", "MET-04", f"""WITH {T.SITES_SQL}, {T.FIELD_SQL}, {EXT}, {WGT},
   tc AS (SELECT poly_id, lat, lon FROM pc JOIN (SELECT DISTINCT poly_id FROM wt) USING (poly_id) SEMI JOIN wt USING (poly_id, lat, lon) UNION ALL SELECT poly_id, lat, lon FROM pc ANTI JOIN wt USING (poly_id))
  SELECT poly_id, date, avg(prcp) AS prcp, avg(t) AS t FROM field JOIN tc USING (lat, lon) GROUP BY 1, 2""", "prcp t", "date")
def met_touched_means(spark, sf):
    f, v = T.field(spark, sf), T.boxes(spark, sf)
    c = T.field_cells(spark, sf)
    return GR.touched_means(f, GR.fractional_weights(v, c, 0.1), v, ["prcp", "t"], 0.1, cells=c)


@query("met_catchment_means", "MET-07", f"""WITH {T.SITES_SQL}, {T.FIELD_SQL}, {EXT}, {WGT}, vb AS (SELECT series_id AS poly_id, seq, lon + r * dx AS lon, lat + r * dy AS lat FROM sites CROSS JOIN (VALUES (0, -1.0, -0.5), (1, 1.0, -0.5), (2, 1.0, 0.5), (3, -1.0, 0.5)) AS v(seq, dx, dy)),
   {area_sql('vb', 'poly_id', 'ba')}, we AS (SELECT poly_id, lat, lon, CASE WHEN area_km2 < 150 THEN w ELSE 1.0 END AS w FROM wt JOIN ba USING (poly_id))
  SELECT poly_id, date, round(greatest(sum(prcp * w) / sum(w), 0), 2) AS prcp FROM field JOIN we USING (lat, lon) GROUP BY 1, 2""", "prcp", "date")
def met_catchment_means(spark, sf):
    f, v = T.field(spark, sf), T.boxes(spark, sf)
    w = GR.fractional_weights(v, T.field_cells(spark, sf), 0.1)
    return two_places(GR.catchment_means(f, w, ["prcp"], areas=SP.polygon_areas(v), small_km2=150.0), "prcp")


@query("met_stale_weights", "MET-05", f"""WITH {T.SITES_SQL}, {T.FIELD_SQL}, {EXT} SELECT DISTINCT poly_id FROM pc WHERE lat > 50.15""")
def met_stale_weights(spark, sf):
    f, v = T.field_cells(spark, sf), T.boxes(spark, sf)
    stored = GR.cells_in_extent(v, f.where("lat <= 50.15"), 0.1)
    return GR.stale_polygons(stored, v, f, 0.1)


@query("met_upsert_days", "MET-08", f"""WITH {T.FORCING_SQL}, o AS (SELECT series_id, date, p_a AS p FROM forcing WHERE date < DATE '2000-01-01'), n AS (SELECT series_id, date, p_b AS p FROM forcing WHERE date >= DATE '1999-06-01')
  SELECT series_id, date, coalesce(n.p, o.p) AS p FROM o FULL JOIN n USING (series_id, date)""", "p", "date")
def met_upsert_days(spark, sf):
    f = T.forcing(spark, sf)
    old = f.where("date < DATE'2000-01-01'").select("series_id", "date", F.col("p_a").alias("p"))
    new = f.where("date >= DATE'1999-06-01'").select("series_id", "date", F.col("p_b").alias("p"))
    return IN.coalesce_tables(new, old, ["series_id", "date"], ["p"])


@query("met_band_sensitivity", "MET-10 MET-11", f"""WITH {T.SITES_SQL}, {T.FIELD_SQL}, {EXT}, {WGT}, vb AS (SELECT series_id AS poly_id, seq, lon + r * dx AS lon, lat + r * dy AS lat FROM sites CROSS JOIN (VALUES (0, -1.0, -0.5), (1, 1.0, -0.5), (2, 1.0, 0.5), (3, -1.0, 0.5)) AS v(seq, dx, dy)),
   {area_sql('vb', 'poly_id', 'ba')}, ww AS (SELECT poly_id, date, sum(prcp * w) / sum(w) AS a, avg(prcp) AS b FROM field JOIN wt USING (lat, lon) GROUP BY 1, 2),
   y AS (SELECT poly_id, year(date) AS y, sum(a) AS a, sum(b) AS b FROM ww GROUP BY 1, 2), x AS (SELECT CASE WHEN area_km2 < 100 THEN 'small' WHEN area_km2 < 400 THEN 'middle' ELSE 'large' END AS band, abs((a - b) / b) * 100 AS rel FROM y JOIN ba USING (poly_id))
  SELECT band, count(rel) AS n, median(rel) AS median_pct, quantile_cont(rel, 0.9) AS p90_pct FROM x GROUP BY 1""", "median_pct p90_pct")
def met_band_sensitivity(spark, sf):
    f, v = T.field(spark, sf), T.boxes(spark, sf)
    w = GR.fractional_weights(v, T.field_cells(spark, sf), 0.1)
    a = GR.catchment_means(f, w, ["prcp"])
    b = GR.catchment_means(f, w.withColumn("w", F.lit(1.0)), ["prcp"])
    return GR.band_sensitivity(a, b, SP.polygon_areas(v), "prcp", (0.0, 100.0, 400.0, 1e9), ("small", "middle", "large"))
