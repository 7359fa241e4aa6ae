"""Queries for baseflow, water balance, trend, homogeneity, change points and drought."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as WB
from ..operators import baseflow as B
from ..operators import drought as DR
from ..operators import trend as TR
from ..sources import tables as T
from .registry import query

FLOW = T.FLOW_SQL
PRODUCTS = {"a": "p_a", "b": "p_b", "c": "p_c"}

# ---- baseflow ----


def _pass(src: str, out: str, rev: bool) -> str:
    """One linear filter pass written as a running sum of geometrically weighted steps."""
    o = "DESC" if rev else "ASC"
    return f"""{out}a AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i {o}) - 1 AS k,
       x - lag(x) OVER (PARTITION BY series_id ORDER BY i {o}) AS dx FROM {src}),
     {out}b AS (SELECT *, pow(al, k) * sum(pow(al, -k) * CASE WHEN k = 0 THEN x ELSE 0.5 * (1 + al) * dx END)
       OVER (PARTITION BY series_id ORDER BY k) AS f FROM {out}a),
     {out} AS (SELECT series_id, i, date, q, al, x - greatest(f, 0) AS x FROM {out}b)"""


def lh_sql(alpha: float, out: str = "bf") -> str:
    return f"""n0 AS (SELECT series_id, date, value AS q, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i,
       count(*) OVER (PARTITION BY series_id) AS n FROM flow),
     pad AS (SELECT series_id, i, date, q, q AS x, CAST({alpha} AS DOUBLE) AS al FROM n0
       UNION ALL SELECT series_id, -i, NULL, NULL, q, {alpha} FROM n0 WHERE i BETWEEN 1 AND 30
       UNION ALL SELECT series_id, 2 * (n - 1) - i, NULL, NULL, q, {alpha} FROM n0 WHERE i BETWEEN n - 31 AND n - 2),
     {_pass('pad', 'f1', False)}, {_pass('f1', 'f2', True)}, {_pass('f2', 'f3', False)},
     {out} AS (SELECT series_id, date, q AS value, greatest(x, 0) AS baseflow FROM f3 WHERE date IS NOT NULL)"""


@query("bfl_separate", "BFL-01 BFL-02 BFL-03 BFL-05", f"WITH {FLOW}, {lh_sql(0.925)} SELECT * FROM bf", "value baseflow", "date")
def bfl_separate(spark, sf):
    return B.separate(T.flow(spark, sf), alpha=0.925)


@query("bfl_stats", "BFL-06", f"""WITH {FLOW}, {lh_sql(0.925)} SELECT *, 1 - bfi AS quickflow_ratio FROM (SELECT series_id, avg(baseflow) / avg(value) AS bfi,
  avg(baseflow) AS baseflow_mean, median(baseflow) AS baseflow_median, stddev_pop(baseflow) AS baseflow_std,
  stddev_pop(baseflow) / avg(baseflow) AS baseflow_cv, min(baseflow) AS baseflow_min, max(baseflow) AS baseflow_max FROM bf GROUP BY 1)""",
  "bfi quickflow_ratio baseflow_mean baseflow_median baseflow_std baseflow_cv baseflow_min baseflow_max")
def bfl_stats(spark, sf):
    return B.baseflow_stats(T.flow(spark, sf), alpha=0.925)


@query("bfl_ensemble_index", "BFL-04 BFL-05")
def bfl_ensemble_index(spark, sf):
    return B.baseflow_index(T.flow(spark, sf))


@query("bfl_index_at_alphas", "BFL-10", f"""WITH {FLOW}, {', '.join(f"z{k} AS (WITH {lh_sql(a)} SELECT series_id, avg(baseflow) / avg(value) AS bfi FROM bf GROUP BY 1)" for k, a in ((1, 0.9), (2, 0.94), (3, 0.98)))}
  SELECT z1.series_id, z1.bfi AS bfi_a0_9, z2.bfi AS bfi_a0_94, z3.bfi AS bfi_a0_98 FROM z1 JOIN z2 USING (series_id) JOIN z3 USING (series_id)""",
  "bfi_a0_9 bfi_a0_94 bfi_a0_98")
def bfl_index_at_alphas(spark, sf):
    return B.index_at_alphas(T.flow(spark, sf), (0.90, 0.94, 0.98))


REC = """rc AS (SELECT series_id, CASE WHEN count(r) < 30 THEN 0.98 ELSE least(0.99, greatest(0.90, median(r))) END AS alpha, count(*) AS n_values FROM
   (SELECT series_id, CASE WHEN value < p AND p > 0 THEN value / p END AS r FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS p FROM {src})) GROUP BY 1)"""


@query("bfl_recession_constant", "BFL-08", f"WITH {T.SUPPLIER_SQL}, {REC.format(src='sup')} SELECT * FROM rc", "alpha")
def bfl_recession_constant(spark, sf):
    return B.recession_constant(T.supplier_flow(spark, sf))


@query("bfl_two_parameter_index", "BFL-07 BFL-09", f"""WITH RECURSIVE {T.SUPPLIER_SQL}, {REC.format(src='sup')},
  x AS (SELECT series_id, value AS q, alpha AS a, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM sup JOIN rc USING (series_id) WHERE n_values >= 365),
  r AS (SELECT series_id, i, a, q AS b FROM x WHERE i = 1 UNION ALL
    SELECT x.series_id, x.i, x.a, greatest(0, least(x.q, ((1 - 0.8) * x.a * r.b + (1 - x.a) * 0.8 * x.q) / (1 - x.a * 0.8))) FROM r JOIN x ON x.series_id = r.series_id AND x.i = r.i + 1)
  SELECT series_id, any_value(a) AS alpha, avg(b) / (SELECT avg(q) FROM x WHERE x.series_id = r.series_id) AS bfi FROM r GROUP BY series_id""", "alpha bfi")
def bfl_two_parameter_index(spark, sf):
    return B.two_parameter_index(T.supplier_flow(spark, sf))


# ---- water balance ----


def _wb(src: str, keys: str = "series_id") -> str:
    return f"""wa AS (SELECT {keys}, hy, coalesce(sum(p), 0) AS p, coalesce(sum(value), 0) AS q FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}) WHERE n >= 365 GROUP BY {keys}, hy),
     w1 AS (SELECT {keys}, CASE WHEN count(*) >= 3 THEN avg(q / nullif(p, 0)) END AS mean_runoff_coefficient, CASE WHEN count(*) >= 3 THEN stddev_samp(q / nullif(p, 0)) END AS std_runoff_coefficient,
       CASE WHEN count(*) >= 3 THEN avg(p) END AS mean_annual_prcp, CASE WHEN count(*) >= 3 THEN avg(q) END AS mean_annual_discharge FROM wa GROUP BY {keys}),
     wc AS (SELECT *, CASE WHEN mean_runoff_coefficient > 0 THEN std_runoff_coefficient / mean_runoff_coefficient END AS cv_runoff_coefficient, mean_annual_prcp - mean_annual_discharge AS mean_water_deficit FROM w1),
     wv AS (SELECT {keys}, CASE WHEN count(*) >= 3 THEN corr(p, q) END AS prcp_discharge_correlation, CASE WHEN count(*) >= 3 THEN regr_slope(q, p) END AS prcp_discharge_slope,
       CASE WHEN count(*) >= 3 THEN regr_intercept(q, p) END AS prcp_discharge_intercept, CASE WHEN count(*) >= 3 THEN regr_r2(q, p) END AS prcp_discharge_r_squared FROM wa GROUP BY {keys})"""


_HY = "year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS hy"
_D = f"{T.FORCING_SQL}, d AS (SELECT series_id, date, gappy AS value, p_a AS p, {_HY} FROM forcing)"
_L = f"""{T.FORCING_SQL}, d AS (SELECT series_id, date, gappy AS value, product, p, pet, {_HY} FROM forcing CROSS JOIN LATERAL (VALUES ('a', p_a), ('b', p_b), ('c', p_c)) AS v(product, p))"""
RC = "mean_runoff_coefficient std_runoff_coefficient mean_annual_prcp mean_annual_discharge cv_runoff_coefficient mean_water_deficit".split()
VR = "prcp_discharge_correlation prcp_discharge_slope prcp_discharge_intercept prcp_discharge_r_squared".split()


def wb_daily(spark, sf):
    return T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value"), F.col("p_a").alias("p"))


@query("wb_runoff_coefficient", "WB-01", f"WITH {_D}, {_wb('d')} SELECT * FROM wc", " ".join(RC))
def wb_runoff_coefficient(spark, sf):
    return WB.runoff_coefficient(wb_daily(spark, sf))


@query("wb_volume_relationship", "WB-02", f"WITH {_D}, {_wb('d')} SELECT * FROM wv", " ".join(VR))
def wb_volume_relationship(spark, sf):
    return WB.volume_relationship(wb_daily(spark, sf))


@query("wb_product_metrics", "WB-03", f"""WITH {_L}, dn AS (SELECT * FROM d WHERE p IS NOT NULL), {_wb('dn', 'series_id, product')}, b AS (SELECT * FROM wc JOIN wv USING (series_id, product))
  SELECT series_id, {', '.join(f"max({c}) FILTER (WHERE product = '{x}') AS {x}_{c}" for x in PRODUCTS for c in RC + VR)} FROM b GROUP BY 1""",
  " ".join(f"{x}_{c}" for x in PRODUCTS for c in RC + VR))
def wb_product_metrics(spark, sf):
    f = T.forcing(spark, sf).withColumn("value", F.col("gappy"))
    return WB.water_balance_metrics(f, PRODUCTS)


def product_days(spark, sf):
    f = T.forcing(spark, sf).withColumn("value", F.col("gappy"))
    return WB.melt_products(f, PRODUCTS, ["series_id", "date", "value", "pet"], drop_null=False)


PK = ["series_id", "product"]
_PR = f"""pr0 AS (SELECT series_id, product, hy, count(*) AS n, count(value) AS nq, count(*) FILTER (WHERE ok) AS np, sum(value) FILTER (WHERE ok) AS q, sum(p) FILTER (WHERE ok) AS p,
    sum(pet) FILTER (WHERE ok) AS e FROM (SELECT *, value IS NOT NULL AND p IS NOT NULL AND pet IS NOT NULL AS ok FROM d) GROUP BY 1, 2, 3),
  pr AS (SELECT series_id, product, count(*) AS n_valid_years, CASE WHEN count(*) >= {{m}} THEN avg(q / p) END AS runoff_ratio, CASE WHEN count(*) >= {{m}} THEN avg(e / p) END AS aridity_index,
    CASE WHEN count(*) >= {{m}} THEN avg((p - q) / p) END AS evaporative_index FROM pr0 WHERE nq >= {{f}} * n AND np >= {{f}} * n AND p > 0 GROUP BY 1, 2)"""


@query("wb_paired_ratios", "WB-04 SIG-42", f"WITH {_L}, {_PR.format(m=5, f=0.7)} SELECT * FROM pr", "runoff_ratio aridity_index evaporative_index")
def wb_paired_ratios(spark, sf):
    return WB.paired_ratios(product_days(spark, sf), PK)


_UN = """un0 AS (SELECT series_id, product, hy, sum(value) AS q, sum(p) AS p, sum(pet) AS e FROM d GROUP BY 1, 2, 3 HAVING count(value) > 0 AND count(p) > 0 AND count(pet) > 0),
  un1 AS (SELECT series_id, product, CASE WHEN count(*) >= 5 THEN avg(e / p) END AS aridity_index, CASE WHEN count(*) >= 5 THEN avg((p - q) / p) END AS evaporative_index FROM un0 WHERE p > 0 GROUP BY 1, 2),
  un2 AS (SELECT series_id, product, avg(value) * 365.25 AS q_mm_yr, avg(p) * 365.25 AS p_mm_yr, avg(pet * 0.8) * 365.25 AS aet_mm_yr, avg(pet) * 365.25 AS pet_mm_yr FROM d GROUP BY 1, 2 HAVING count(value) >= 1825),
  un AS (SELECT series_id, product, q_mm_yr, p_mm_yr, aet_mm_yr, pet_mm_yr, aridity_index, evaporative_index, p_mm_yr - q_mm_yr AS aet_wb_mm_yr, p_mm_yr - q_mm_yr - aet_mm_yr AS aet_wb_minus_product_mm_yr,
    (p_mm_yr - q_mm_yr) / aet_mm_yr AS aet_wb_div_product, coalesce(p_mm_yr - q_mm_yr > pet_mm_yr, false) AS aet_wb_gt_pet, coalesce(p_mm_yr - q_mm_yr < 0, false) AS aet_wb_lt_zero FROM un2 LEFT JOIN un1 USING (series_id, product))"""


@query("wb_unpaired_ratios", "WB-05", f"WITH {_L}, {_UN} SELECT * FROM un",
       "q_mm_yr p_mm_yr aet_mm_yr pet_mm_yr aridity_index evaporative_index aet_wb_mm_yr aet_wb_minus_product_mm_yr aet_wb_div_product")
def wb_unpaired_ratios(spark, sf):
    return WB.unpaired_ratios(product_days(spark, sf).withColumn("aet", F.col("pet") * 0.8), PK)


@query("wb_budyko_summary", "WB-06", f"""WITH {_L}, {_PR.format(m=3, f=0.3)}, x AS (SELECT *, evaporative_index - sqrt(greatest(aridity_index * tanh(1 / aridity_index) * (1 - exp(-aridity_index)), 0)) AS dep FROM pr WHERE aridity_index IS NOT NULL)
  SELECT product, count(*) AS n_series, avg(CASE WHEN runoff_ratio > 1 THEN 100.0 ELSE 0 END) AS runoff_ratio_gt_1_pct, avg(CASE WHEN evaporative_index > aridity_index THEN 100.0 ELSE 0 END) AS aet_wb_gt_pet_pct,
   avg(CASE WHEN dep < 0 THEN 100.0 ELSE 0 END) AS below_budyko_pct, count(*) FILTER (WHERE aridity_index < 0) AS x_below, count(*) FILTER (WHERE aridity_index > 3.5) AS x_above,
   count(*) FILTER (WHERE evaporative_index < -0.3) AS y_below, count(*) FILTER (WHERE evaporative_index > 1.5) AS y_above,
   count(*) FILTER (WHERE aridity_index < 0 OR aridity_index > 3.5 OR evaporative_index < -0.3 OR evaporative_index > 1.5) AS outside_union,
   median(runoff_ratio) AS median_runoff_ratio, median(dep) AS median_budyko_departure FROM x GROUP BY 1""",
  "runoff_ratio_gt_1_pct aet_wb_gt_pet_pct below_budyko_pct median_runoff_ratio median_budyko_departure")
def wb_budyko_summary(spark, sf):
    return WB.budyko_summary(WB.paired_ratios(product_days(spark, sf), PK, min_fraction=0.3, min_years=3))


@query("val_budyko_attribute", "VAL-08", f"""WITH {_L}, {_PR.format(m=3, f=0.3)}, x AS (SELECT product, a, evaporative_index - sqrt(greatest(aridity_index * tanh(1 / aridity_index) * (1 - exp(-aridity_index)), 0)) AS dep, runoff_ratio FROM pr JOIN (SELECT series_id, avg(t) AS a FROM forcing GROUP BY 1) USING (series_id) WHERE aridity_index IS NOT NULL AND evaporative_index IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY product ORDER BY a) + (count(*) OVER (PARTITION BY product, a) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY product ORDER BY dep) + (count(*) OVER (PARTITION BY product, dep) - 1) / 2.0 AS ry FROM x)
  SELECT product, corr(rx, ry) AS rho, count(*) AS n_pairs, count(*) FILTER (WHERE a < 0.05) AS n_low, median(dep) FILTER (WHERE a < 0.05) AS low_median_departure, median(runoff_ratio) FILTER (WHERE a < 0.05) AS low_median_runoff_ratio FROM r GROUP BY 1""",
  "rho low_median_departure low_median_runoff_ratio")
def val_budyko_attribute(spark, sf):
    """Rank correlation of an attribute with the departure per product, and medians where the attribute is low."""
    s = T.forcing(spark, sf).groupBy("series_id").agg(F.avg("t").alias("attribute"))
    return WB.departure_by_attribute(WB.paired_ratios(product_days(spark, sf), PK, min_fraction=0.3, min_years=3).join(s, "series_id"), "attribute", 0.05)



_CK = (("energy_violation", "evaporative_index > aridity_index"), ("water_limit_violation", "evaporative_index > 1"), ("combined_envelope_violation", "evaporative_index > least(aridity_index, 1)"),
       ("closure_q_gt_p", "evaporative_index < 0"), ("aet_wb_gt_pet", "aet_wb_gt_pet"), ("aet_wb_lt_zero", "aet_wb_lt_zero"))
_MD = ("aridity_index", "evaporative_index", "q_mm_yr", "p_mm_yr", "aet_wb_mm_yr", "aet_wb_minus_product_mm_yr")


@query("wb_violation_summary", "WB-07", f"""WITH {_L}, {_UN} SELECT product, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE {c}) AS {n}_n, count(*) FILTER (WHERE {c}) * 100.0 / count(*) AS {n}_pct" for n, c in _CK)},
  {', '.join(f"median({c}) AS median_{c}" for c in _MD)} FROM un WHERE aridity_index IS NOT NULL GROUP BY 1""",
  " ".join([f"{n}_pct" for n, _ in _CK] + [f"median_{c}" for c in _MD]))
def wb_violation_summary(spark, sf):
    return WB.violation_summary(WB.unpaired_ratios(product_days(spark, sf).withColumn("aet", F.col("pet") * 0.8), PK))


@query("wb_common_day_balance", "WB-08", f"""WITH {_D}, y AS (SELECT series_id, year(date) AS y, sum(p) AS p, sum(value) AS q FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM d WHERE value IS NOT NULL AND p IS NOT NULL) WHERE n >= 365 GROUP BY 1, 2)
  SELECT series_id, median(q / p) AS qp_ratio, avg(p - q) AS et_proxy_mm, avg(p) AS p_annual_mm, avg(q) AS q_annual_mm FROM y GROUP BY 1 HAVING count(*) >= 3""", "qp_ratio et_proxy_mm p_annual_mm q_annual_mm")
def wb_common_day_balance(spark, sf):
    return WB.common_day_balance(wb_daily(spark, sf))


# ---- trend ----

OBS = f"{T.FORCING_SQL}, d AS (SELECT series_id, date, gappy AS value FROM forcing), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i, count(*) OVER (PARTITION BY series_id) AS n, avg(value) OVER (PARTITION BY series_id) AS m, stddev_samp(value) OVER (PARTITION BY series_id) AS sd FROM d WHERE value IS NOT NULL)"


def tr_daily(spark, sf):
    return T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value"))


def _lin(src: str, keys: str = "series_id") -> str:
    return f"""SELECT {keys}, slope, intercept, r_squared, sqrt(greatest(0, (1 - r_squared) * syy / (sxx * (n_observations - 2)))) AS std_error, slope * 10 AS trend_per_decade,
     CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'no trend' END AS trend_direction, CAST(y0 AS INTEGER) AS start_year, CAST(y1 AS INTEGER) AS end_year, n_observations
    FROM (SELECT {keys}, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, regr_r2(value, x) AS r_squared, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy, count(value) AS n_observations, max(y0) AS y0, max(year(date)) AS y1
     FROM (SELECT *, year(date) - year(min(date) OVER (PARTITION BY {keys})) AS x, year(min(date) OVER (PARTITION BY {keys})) AS y0 FROM {src}) GROUP BY {keys}) WHERE n_observations >= 3"""


LIN_D = "slope intercept r_squared std_error trend_per_decade"


@query("trd_linear", "TRD-01", f"WITH {OBS} {_lin('d')}", LIN_D)
def trd_linear(spark, sf):
    return TR.linear_trend(tr_daily(spark, sf)).drop("p_value", "trend_significant")


def _mk(src: str, keys: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join("a." + k.strip() for k in keys.split(","))
    return f"""k0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS j FROM {src}),
     k1 AS (SELECT {ak}, sum(sign(b.value - a.value)) AS s, median((b.value - a.value) / (b.j - a.j)) AS sen FROM k0 a JOIN k0 b ON {on} AND a.j < b.j GROUP BY {ak}),
     k2 AS (SELECT {keys}, sum(c) AS n, sum(CAST(c AS DOUBLE) * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT {keys}, value, count(*) AS c FROM {src} GROUP BY {keys}, value) GROUP BY {keys}),
     mk AS (SELECT {keys}, CAST(n AS BIGINT) AS n, s, sen, (n * (n - 1) * (2 * n + 5) - tie) / 18.0 AS var_s FROM k1 JOIN k2 USING ({keys}) WHERE n >= 3)"""


ZS = "CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END"


@query("trd_mann_kendall", "TRD-02", f"""WITH {OBS}, {_mk('o', 'series_id')} SELECT series_id, n AS n_observations, s AS s_statistic, var_s, {ZS} AS z_statistic, s / (n * (n - 1) / 2.0) AS tau, sen AS slope FROM mk""",
  "s_statistic var_s z_statistic tau slope")
def trd_mann_kendall(spark, sf):
    return TR.mann_kendall(tr_daily(spark, sf)).drop("p_value", "trend")


@query("trd_seasonal_mann_kendall", "TRD-03", f"""WITH {OBS}, om AS (SELECT series_id, month(date) AS month, date, value FROM o), {_mk('om', 'series_id, month')}, t AS (SELECT series_id, sum(s) AS s, sum(var_s) AS var_s FROM mk GROUP BY 1)
  SELECT series_id, s AS s_statistic, var_s, {ZS} AS z_statistic FROM t""", "s_statistic var_s z_statistic")
def trd_seasonal_mann_kendall(spark, sf):
    return TR.seasonal_mann_kendall(tr_daily(spark, sf)).drop("p_value", "trend")


@query("trd_piecewise", "TRD-04", f"""WITH {OBS}, seg AS (SELECT * FROM (VALUES (1, 1995, 1998), (2, 1998, 2000), (3, 2000, 2001)) AS v(segment, lo, hi)),
   r AS (SELECT d.*, segment FROM d JOIN seg ON year(date) BETWEEN lo AND hi) {_lin('r', 'series_id, segment')}""", LIN_D)
def trd_piecewise(spark, sf):
    d = tr_daily(spark, sf)
    breaks = d.select("series_id").distinct().select("series_id", F.explode(F.array(F.lit(1998), F.lit(2000))).alias("year"))
    return TR.piecewise_trends(d, breaks).drop("p_value", "trend_significant")


@query("trd_variance_breakpoints", "TRD-04", f"""WITH {T.SUPPLIER_SQL},
  r AS (SELECT series_id, date, row_number() OVER o AS i, count(*) OVER p AS n, value - avg(value) OVER p AS z FROM sup WINDOW o AS (PARTITION BY series_id ORDER BY date), p AS (PARTITION BY series_id)),
  s AS (SELECT *, greatest(5, n // 10) AS w, sum(z) OVER o AS s, sum(z * z) OVER o AS q FROM r WINDOW o AS (PARTITION BY series_id ORDER BY date)),
  v AS (SELECT a.series_id, a.date, a.i, CASE WHEN a.i - a.w // 2 >= 1 AND b.i IS NOT NULL THEN (b.q - coalesce(c.q, 0) - (b.s - coalesce(c.s, 0)) ** 2 / a.w) / (a.w - 1) END AS v
    FROM s a LEFT JOIN s b ON b.series_id = a.series_id AND b.i = a.i + (a.w - 1) // 2 LEFT JOIN s c ON c.series_id = a.series_id AND c.i = a.i - a.w // 2 - 1),
  j AS (SELECT series_id, year(date) AS year, abs(v - lag(v) OVER (PARTITION BY series_id ORDER BY i)) AS jump, year(min(date) OVER p) AS y1, year(max(date) OVER p) AS y2 FROM v WINDOW p AS (PARTITION BY series_id)),
  t AS (SELECT series_id, quantile_cont(jump, 0.9) AS top FROM j GROUP BY 1)
  SELECT DISTINCT series_id, year FROM j JOIN t USING (series_id) WHERE jump > top AND year > y1 + 2 AND year < y2 - 2""")
def trd_variance_breakpoints(spark, sf):
    return TR.variance_breakpoints(T.supplier_flow(spark, sf))


@query("trd_annual", "TRD-05", f"""WITH {OBS}, an AS (SELECT series_id, make_date(CAST(year(date) AS INTEGER), 12, 31) AS date, avg(value) AS value FROM d GROUP BY 1, 2), {_mk('an', 'series_id')}, l AS ({_lin('an')})
  SELECT series_id, slope AS linear_slope, r_squared AS linear_r_squared, s / (n * (n - 1) / 2.0) AS mk_tau, sen AS mk_slope FROM l JOIN mk USING (series_id)""", "linear_slope linear_r_squared mk_tau mk_slope")
def trd_annual(spark, sf):
    return TR.annual_trends(tr_daily(spark, sf)).select("series_id", "linear_slope", "linear_r_squared", "mk_tau", "mk_slope")


@query("trd_analyze", "TRD-06")
def trd_analyze(spark, sf):
    return TR.analyze_trends(tr_daily(spark, sf))


# ---- homogeneity ----


@query("hom_pettitt", "HOM-01", f"""WITH {OBS}, r AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY value) + (count(*) OVER (PARTITION BY series_id, value) - 1) / 2.0 AS rk FROM o),
  u AS (SELECT *, abs(2 * sum(rk) OVER (PARTITION BY series_id ORDER BY date) - i * (n + 1)) AS u FROM r), x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY u DESC, i) AS o1 FROM u WHERE i < n)
  SELECT series_id, u AS kt_statistic, i AS change_point_index, date AS change_point_date, n AS n_observations, 2 * exp(-6 * u ** 2 / (CAST(n AS DOUBLE) ** 3 + CAST(n AS DOUBLE) ** 2)) AS p_value,
   1.36 * sqrt(n) AS critical_value, 2 * exp(-6 * u ** 2 / (CAST(n AS DOUBLE) ** 3 + CAST(n AS DOUBLE) ** 2)) < 0.05 AS change_point_detected FROM x WHERE o1 = 1""", "kt_statistic p_value critical_value", "change_point_date")
def hom_pettitt(spark, sf):
    return TR.pettitt(tr_daily(spark, sf)).withColumn("change_point_index", F.col("change_point_index").cast("bigint"))


@query("hom_buishand", "HOM-02", f"""WITH {OBS}, c AS (SELECT *, sum(value - m) OVER (PARTITION BY series_id ORDER BY date) AS c FROM o),
  x AS (SELECT series_id, max(c) - min(c) AS range, any_value(sd) AS sd, count(*) AS n FROM c GROUP BY 1)
  SELECT series_id, range, range / (sd * sqrt(n)) AS q_statistic, CASE WHEN n >= 50 THEN 1.747 ELSE 1.4 + 0.3 * log10(n) END AS critical_value, n AS n_observations,
   range / (sd * sqrt(n)) < CASE WHEN n >= 50 THEN 1.747 ELSE 1.4 + 0.3 * log10(n) END AS homogeneous FROM x WHERE n >= 10""", "range q_statistic critical_value")
def hom_buishand(spark, sf):
    return TR.buishand(tr_daily(spark, sf)).drop("p_value_approx")


@query("hom_snht", "HOM-03", f"""WITH {OBS}, c AS (SELECT *, avg((value - m) / sd) OVER (PARTITION BY series_id ORDER BY date) AS z1,
   avg((value - m) / sd) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z2 FROM o),
  x AS (SELECT *, i * z1 ** 2 + (n - i) * z2 ** 2 AS t, row_number() OVER (PARTITION BY series_id ORDER BY i * z1 ** 2 + (n - i) * z2 ** 2 DESC, i) AS o1 FROM c WHERE i < n)
  SELECT series_id, t AS t_statistic, 8.45 AS critical_value, i AS change_point_index, date AS change_point_date, n AS n_observations, t > 8.45 AS change_point_detected FROM x WHERE o1 = 1""", "t_statistic critical_value", "change_point_date")
def hom_snht(spark, sf):
    return TR.snht(tr_daily(spark, sf)).withColumn("change_point_index", F.col("change_point_index").cast("bigint"))


@query("hom_von_neumann", "HOM-04", f"""WITH {OBS}, x AS (SELECT series_id, sum(d ** 2) / sum((value - m) ** 2) AS r, count(*) AS n FROM (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS d FROM o) GROUP BY 1)
  SELECT series_id, r AS von_neumann_ratio, n AS n_observations, (r - 2) / sqrt(4.0 * (n - 2) / ((n + 1.0) * (n - 1))) AS z_statistic FROM x""", "von_neumann_ratio z_statistic")
def hom_von_neumann(spark, sf):
    return TR.von_neumann(tr_daily(spark, sf)).drop("p_value", "significant")


@query("hom_runs", "HOM-05", f"""WITH {OBS}, b AS (SELECT *, value > median(value) OVER (PARTITION BY series_id) AS up FROM o), t AS (SELECT *, up <> lag(up) OVER (PARTITION BY series_id ORDER BY date) AS turn FROM b),
  x AS (SELECT series_id, count(*) FILTER (WHERE turn) + 1 AS runs, count(*) FILTER (WHERE up) AS a, count(*) FILTER (WHERE NOT up) AS b, count(*) AS n FROM t GROUP BY 1),
  y AS (SELECT *, 2.0 * a * b / n + 1 AS e, 2.0 * a * b * (2.0 * a * b - n) / (CAST(n AS DOUBLE) ** 2 * (n - 1)) AS v FROM x)
  SELECT series_id, runs, a AS n_above_median, b AS n_below_median, n AS n_observations, e AS expected_runs, (runs - e + CASE WHEN runs > e THEN -0.5 ELSE 0.5 END) / sqrt(v) AS z_statistic FROM y""", "expected_runs z_statistic")
def hom_runs(spark, sf):
    return TR.runs_about_median(tr_daily(spark, sf)).drop("p_value", "significant")


@query("hom_ljung_box", "HOM-06", f"""WITH {OBS}, l AS (SELECT series_id, value, {', '.join(f"lag(value, {k}) OVER w AS l{k}" for k in range(1, 11))} FROM o WINDOW w AS (PARTITION BY series_id ORDER BY date)),
  x AS (SELECT series_id, count(*) AS n, {', '.join(f"corr(value, l{k}) AS r{k}" for k in range(1, 11))} FROM l GROUP BY 1)
  SELECT series_id, n AS n_observations, n * (n + 2.0) * ({' + '.join(f"r{k} ** 2 / (n - {k})" for k in range(1, 11))}) AS lb_statistic FROM x""", "lb_statistic")
def hom_ljung_box(spark, sf):
    return TR.ljung_box(tr_daily(spark, sf)).select("series_id", "n_observations", "lb_statistic")


@query("hom_all_tests", "HOM-07")
def hom_all_tests(spark, sf):
    return TR.homogeneity(tr_daily(spark, sf))


# ---- change points ----


@query("cpt_cusum", "CPT-01", f"""WITH RECURSIVE {T.SUPPLIER_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, value - avg(value) OVER (PARTITION BY series_id) AS d,
    2 * stddev_samp(value) OVER (PARTITION BY series_id) AS lim FROM sup),
  r AS (SELECT series_id, i, date, value, lim, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS dn, CAST(0 AS DOUBLE) AS ku, CAST(0 AS DOUBLE) AS kd, false AS hit FROM o WHERE i = 0 UNION ALL
   SELECT o.series_id, o.i, o.date, o.value, o.lim, greatest(0, ku + o.d), least(0, kd + o.d),
     CASE WHEN greatest(0, ku + o.d) > o.lim OR -least(0, kd + o.d) > o.lim THEN 0 ELSE greatest(0, ku + o.d) END,
     CASE WHEN greatest(0, ku + o.d) > o.lim OR -least(0, kd + o.d) > o.lim THEN 0 ELSE least(0, kd + o.d) END,
     greatest(0, ku + o.d) > o.lim OR -least(0, kd + o.d) > o.lim FROM r JOIN o ON o.series_id = r.series_id AND o.i = r.i + 1)
  SELECT series_id, date, value, CAST(i AS INTEGER) AS index, up AS cusum_pos, dn AS cusum_neg, lim AS threshold FROM r WHERE hit""", "value cusum_pos cusum_neg threshold", "date")
def cpt_cusum(spark, sf):
    return TR.cusum(T.supplier_flow(spark, sf))


def _reduction(a: str, b: str) -> str:
    """Variance of the values from index a to before b, from prefix sums."""
    return f"greatest({b}.c2 - {a}.c2 - ({b}.c1 - {a}.c1) ** 2 / ({b}.k - {a}.k), 0) / ({b}.k - {a}.k - 1)"


# Every part of a series is split at its best index until none reduces the variance; parts keep 10 days.
SPLITS = f"""WITH RECURSIVE {OBS}, c AS (SELECT series_id, i - 1 AS k, n, date, value, coalesce(sum(value - m) OVER w, 0) AS c1, coalesce(sum((value - m) ** 2) OVER w, 0) AS c2 FROM o WHERE n >= 20
    WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  sg AS (SELECT series_id, 0 AS lo, n - 1 AS hi, CAST(NULL AS BIGINT) AS cp, CAST(NULL AS DOUBLE) AS score FROM c WHERE k = 0
    UNION ALL SELECT series_id, unnest([lo, pos]) AS lo, unnest([pos, hi]) AS hi, pos AS cp, sc AS score FROM (
      SELECT series_id, lo, hi, arg_max(k, sc) AS pos, max(sc) AS sc FROM (
        SELECT s.series_id, s.lo, s.hi, x.k, 1 - ((x.k - s.lo) * ({_reduction('a', 'x')}) + (s.hi - x.k) * ({_reduction('x', 'b')})) / ((s.hi - s.lo) * nullif({_reduction('a', 'b')}, 0)) AS sc
        FROM sg s JOIN c a ON a.series_id = s.series_id AND a.k = s.lo JOIN c b ON b.series_id = s.series_id AND b.k = s.hi
        JOIN c x ON x.series_id = s.series_id AND x.k >= s.lo + 10 AND x.k < s.hi - 10) GROUP BY 1, 2, 3) WHERE sc > 0),
  sp AS (SELECT DISTINCT series_id, cp, score FROM sg WHERE cp IS NOT NULL)"""


@query("cpt_binary_segmentation", "CPT-02", f"{SPLITS} SELECT sp.series_id, date, value, CAST(cp AS INTEGER) AS index, score FROM sp JOIN c ON c.series_id = sp.series_id AND k = cp", "value score", "date")
def cpt_binary_segmentation(spark, sf):
    return TR.binary_segmentation(tr_daily(spark, sf))


@query("cpt_segments", "CPT-02", f"""{SPLITS}, nb AS (SELECT o.*, CAST(coalesce(sum(CASE WHEN cp IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o.series_id ORDER BY i), 0) AS BIGINT) AS segment FROM o LEFT JOIN sp ON sp.series_id = o.series_id AND cp = i - 1)
  SELECT series_id, segment, min(date) AS start_date, max(date) AS end_date, count(*) AS length, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM nb GROUP BY 1, 2""", "mean std min max", "start_date end_date")
def cpt_segments(spark, sf):
    d = tr_daily(spark, sf)
    return TR.segment_stats(d, TR.binary_segmentation(d))


@query("cpt_variance", "CPT-03", f"""WITH {OBS}, v AS (SELECT *, CASE WHEN count(*) OVER w = 50 THEN var_samp(value) OVER w END AS va FROM o WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)),
  b AS (SELECT *, lag(va) OVER (PARTITION BY series_id ORDER BY date) AS vb FROM v), t AS (SELECT *, quantile_cont(abs(va - vb), 0.95) OVER (PARTITION BY series_id) AS thr FROM b)
  SELECT series_id, date, value, CAST(i - 1 AS INTEGER) AS index, abs(va - vb) AS variance_change, vb AS variance_before, va AS variance_after FROM t WHERE abs(va - vb) > thr""", "value variance_change variance_before variance_after", "date")
def cpt_variance(spark, sf):
    return TR.variance_change(tr_daily(spark, sf))


@query("cpt_mean_shift_scores", "CPT-04", f"""WITH {OBS}, x AS (SELECT *, count(*) OVER a AS na, avg(value) OVER a AS ma, var_samp(value) OVER a AS va, count(*) OVER b AS nb, avg(value) OVER b AS mb, var_samp(value) OVER b AS vb FROM o
   WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT series_id, date, value, CAST(i - 1 AS INTEGER) AS index, n, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2.0) * (1.0 / na + 1.0 / nb)) AS t_statistic, ma AS mean_before, mb AS mean_after, mb - ma AS mean_difference
  FROM x WHERE na >= 20 AND na < n - 20""", "value t_statistic mean_before mean_after mean_difference", "date")
def cpt_mean_shift_scores(spark, sf):
    return TR.mean_shift_scores(tr_daily(spark, sf))


@query("cpt_mean_shift", "CPT-04")
def cpt_mean_shift(spark, sf):
    return TR.mean_shift(T.supplier_flow(spark, sf), alpha=0.05)


@query("cpt_all_methods", "CPT-05")
def cpt_all_methods(spark, sf):
    return TR.change_points(tr_daily(spark, sf))


# ---- drought ----


def monthly(spark, sf):
    f = T.forcing(spark, sf)
    p = DR.monthly_totals(f.select("series_id", "date", F.col("p_a").alias("value")))
    t = DR.monthly_totals(f.select("series_id", "date", F.col("t").alias("value")), how="mean").withColumnRenamed("value", "t")
    return p.join(t, ["series_id", "month"], "left")


MON = f"""{T.FORCING_SQL}, m0 AS (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(p_a) AS value, avg(t) AS t FROM forcing GROUP BY 1, 2),
  mg AS (SELECT series_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m0 GROUP BY 1),
  mo AS (SELECT mg.series_id, mg.month, coalesce(value, 0) AS value, t FROM mg LEFT JOIN m0 ON m0.series_id = mg.series_id AND m0.month = mg.month)"""


def _roll(src: str, k: int) -> str:
    return f"""r0 AS (SELECT series_id, month, CASE WHEN count(*) OVER w = {k} THEN sum(value) OVER w END AS x FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS {k - 1} PRECEDING)),
   ro AS (SELECT * FROM (SELECT *, count(x) OVER (PARTITION BY series_id) AS n_valid FROM r0) WHERE n_valid >= 30)"""


@query("drt_monthly_totals", "DRT-01", f"WITH {MON} SELECT * FROM mo", "value t", "month")
def drt_monthly_totals(spark, sf):
    return monthly(spark, sf)


@query("drt_rolling_sum", "DRT-01", f"WITH {MON}, {_roll('mo', 6)} SELECT * FROM ro", "x", "month")
def drt_rolling_sum(spark, sf):
    return DR.rolling_sum(monthly(spark, sf), 6)


@query("drt_spi_gamma", "DRT-01")
def drt_spi_gamma(spark, sf):
    return DR.spi(monthly(spark, sf), 12)


@query("drt_spi_pearson3", "DRT-02")
def drt_spi_pearson3(spark, sf):
    return DR.spi(monthly(spark, sf), 12, distribution="pearson3")


BAL = f"{MON}, cb AS (SELECT series_id, month, coalesce(value - CASE WHEN t >= 0 THEN 16 * pow(10 * t / 25, 1.5) END, 0) AS value FROM mo)"


@query("drt_spei_rank", "DRT-03 DRT-04", f"""WITH {BAL}, {_roll('cb', 6)} SELECT series_id, month, x AS balance, CASE WHEN x IS NOT NULL THEN CASE WHEN pr = 0 THEN 1.0 / (2 * n_valid) ELSE pr END END AS prob FROM
  (SELECT *, (rank() OVER (PARTITION BY series_id ORDER BY x NULLS LAST) - 1) * 1.0 / n_valid AS pr FROM ro)""", "balance prob", "month")
def drt_spei_rank(spark, sf):
    return DR.spei(monthly(spark, sf), 6).drop("spei")


@query("drt_spei", "DRT-03")
def drt_spei(spark, sf):
    return DR.spei(monthly(spark, sf), 6)


@query("drt_cumulative_departure", "DRT-05", f"""WITH {BAL}, dp AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id, month(month)) AS dep FROM cb)
  SELECT series_id, month, sum(dep) OVER (PARTITION BY series_id ORDER BY month) / stddev_samp(dep) OVER (PARTITION BY series_id) AS pdsi FROM dp""", "pdsi", "month")
def drt_cumulative_departure(spark, sf):
    return DR.cumulative_departure(monthly(spark, sf))


@query("drt_aridity", "DRT-06", f"""WITH {MON}, y AS (SELECT series_id, year(month) AS y, sum(value) AS p, coalesce(sum(CASE WHEN t >= 0 THEN 16 * pow(10 * t / 25, 1.5) END), 0) AS e FROM mo GROUP BY 1, 2)
  SELECT series_id, avg(p) / avg(e) AS aridity_index FROM y GROUP BY 1""", "aridity_index")
def drt_aridity(spark, sf):
    return DR.aridity(monthly(spark, sf))


@query("drt_dry_spells", "DRT-07", f"""WITH {T.SUPPLIER_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - row_number() OVER (PARTITION BY series_id, value < 20 ORDER BY date) AS g FROM sup),
  l AS (SELECT series_id, g, count(*) AS len FROM f WHERE value < 20 GROUP BY 1, 2), s AS (SELECT series_id, count(*) AS n FROM sup GROUP BY 1)
  SELECT s.series_id, coalesce(max(len), 0) AS max_consecutive_dry_days, coalesce(avg(len), 0) AS mean_consecutive_dry_days, greatest(count(len), 1) AS total_dry_periods, CAST(coalesce(sum(len), 0) AS BIGINT) AS total_dry_days,
   coalesce(sum(len), 0) * 100.0 / any_value(n) AS dry_day_percentage FROM s LEFT JOIN l USING (series_id) GROUP BY 1""", "mean_consecutive_dry_days dry_day_percentage")
def drt_dry_spells(spark, sf):
    return DR.dry_spells(T.supplier_flow(spark, sf), threshold=20.0)


@query("drt_index_table", "DRT-08")
def drt_index_table(spark, sf):
    return DR.drought_table(monthly(spark, sf))
