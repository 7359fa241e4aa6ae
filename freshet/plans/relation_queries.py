"""Queries for attributes, relations, clustering, validation, release tables and streams."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.lineage import stash
from ..functions.stats import std_from_sums
from ..operators import attributes as AT
from ..operators import clustering as CL
from ..operators import filters as FL
from ..operators import hierarchy as HI
from ..operators import ingest as IN
from ..operators import overlay as OL
from ..operators import relations as RL
from ..operators import signatures as SG
from ..operators import validation as VA
from ..sources import release as RS
from ..sources import tables as T
from ..streaming import streams as ST
from .ingest_queries import _grades, match_input, OV
from .quality_queries import supplier_years
from .registry import REGISTRY, query
from .signature_queries import period_sql

# ---- attributes: parts supplied by suppliers play the overlapping polygons ----


def overlaps(spark, sf):
    li = T.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("overlap_km2"))
    p = T.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_suppkey").cast("string").alias("series_id"), "overlap_km2", "size", "price")


OVL = """ol AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, sum(l_quantity) AS w, any_value(p_size) AS size, any_value(CASE WHEN p_size > 10 THEN p_retailprice END) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, l_partkey)"""


@query("att_area_weighted", "ATT-01", f"WITH {OVL} SELECT series_id, sum(w * size) / sum(w) AS size, sum(w * price) / sum(w) FILTER (WHERE price IS NOT NULL) AS price, sum(w) AS overlap_km2, count(*) AS n_polygons FROM ol GROUP BY 1", "size price overlap_km2")
def att_area_weighted(spark, sf):
    return AT.area_weighted(overlaps(spark, sf), ["size", "price"])


@query("att_extract", "ATT-02", f"""WITH {OVL} SELECT series_id, sum(w * size) / sum(w) / 10 AS size, sum(w * price) / sum(w) FILTER (WHERE price IS NOT NULL) AS price, sum(w) / any_value(s_acctbal + 2000) AS area_fraction_used, count(*) AS n_polygons
  FROM ol JOIN supplier ON series_id = CAST(s_suppkey AS VARCHAR) WHERE w >= 5 GROUP BY 1""", "size price area_fraction_used")
def att_extract(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"), (F.col("s_acctbal") + 2000).alias("area_km2"))
    return AT.extract_attributes(s, overlaps(spark, sf), ["size", "price"], scale={"size": 10.0})


def customer_boxes(spark, sf):
    """Rectangles around customers, which carry attributes of their own."""
    k, r = F.col("c_custkey"), 0.02 + 0.1 * (F.col("c_acctbal") + 1000.0) / 11000.0
    c = T.table(spark, sf, "customer").select(
        k.cast("string").alias("series_id"), (30.0 + 0.02 * (k % 2000)).alias("lon"),
        (50.0 + 0.5 * F.floor(k / 2000) + 0.01 * (k % 7)).alias("lat"), r.alias("r"))
    return T._corners(c, [(-1.0, -0.5), (1.0, -0.5), (1.0, 0.5), (-1.0, 0.5)])


KM2 = OL.KM2
LAYER_SQL = f"""{T.SITES_SQL}, ab AS (SELECT series_id AS a_id, s, lon + r * u1 AS x1, lon + r * u2 AS x2, lat + r * v1 AS y1, lat + r * v2 AS y2 FROM sites
    CROSS JOIN (VALUES (1, -1.0, 1.0, -0.5, 0.5), (-1, -0.5, 0.5, -0.25, 0.25), (1, 1.5, 2.5, -0.25, 0.25)) AS u(s, u1, u2, v1, v2)),
  cu AS (SELECT CAST(c_custkey AS VARCHAR) AS b_id, 30.0 + CAST(0.02 AS DOUBLE) * (c_custkey % 2000) AS lon, CAST(50.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (c_custkey // 2000) + CAST(0.01 AS DOUBLE) * (c_custkey % 7) AS lat,
    CAST(0.02 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (c_acctbal + 1000.0) / 11000.0 AS r, CAST(c_nationkey AS DOUBLE) AS nation, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance FROM customer),
  ov AS (SELECT a_id, b_id, any_value(nation) AS nation, any_value(balance) AS balance, {KM2} * sum(s * greatest(0, least(x2, lon + r) - greatest(x1, lon - r))
    * greatest(0, degrees(sin(radians(least(y2, lat + r / 2)))) - degrees(sin(radians(greatest(y1, lat - r / 2)))))) AS km2 FROM ab JOIN cu ON x1 < lon + r AND x2 > lon - r AND y1 < lat + r / 2 AND y2 > lat - r / 2 GROUP BY 1, 2)"""


@query("att_polygon_overlay", "ATT-02 MET-02", f"WITH {LAYER_SQL} SELECT a_id, b_id, km2 AS overlap_km2 FROM ov WHERE km2 > 0.001", "overlap_km2")
def att_polygon_overlay(spark, sf):
    return OL.overlaps(T.holed_boxes(spark, sf), customer_boxes(spark, sf)).where("overlap_km2 > 0.001")


@query("att_extract_overlay", "ATT-02", f"""WITH {LAYER_SQL}, ca AS (SELECT a_id, {KM2} * sum(s * (x2 - x1) * (degrees(sin(radians(y2))) - degrees(sin(radians(y1))))) AS area FROM ab GROUP BY 1)
  SELECT a_id AS series_id, sum(km2 * nation) / sum(km2) / 10 AS nation, sum(km2 * balance) / sum(km2) FILTER (WHERE balance IS NOT NULL) AS balance, sum(km2) / any_value(area) AS area_fraction_used, count(*) AS n_polygons
  FROM ov JOIN ca USING (a_id) WHERE km2 >= 5 GROUP BY 1""", "nation balance area_fraction_used")
def att_extract_overlay(spark, sf):
    """Attributes of catchments from the polygons of a layer, by overlaps of 5 km2 or more."""
    shapes = T.holed_boxes(spark, sf)
    layer = T.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("b_id"), F.col("c_nationkey").cast("double").alias("nation"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("double")).alias("balance"))
    return AT.extract_from_layer(shapes, customer_boxes(spark, sf), layer, ["nation", "balance"], scale={"nation": 10.0})


def part_matrix(spark, sf):
    p = T.table(spark, sf, "part")
    return p.select(
        F.col("p_size").cast("double").alias("a1"), "p_retailprice", F.when(F.col("p_size") > 5, F.col("p_size") * 2.0 + F.col("p_retailprice") / 100).alias("a2"),
        (F.col("p_partkey") % 97).cast("double").alias("a3"), (F.col("p_size") % 2).cast("double").alias("a4"), F.length("p_name").cast("double").alias("a5"))


PM = "pm AS (SELECT CAST(p_size AS DOUBLE) AS a1, p_retailprice, CASE WHEN p_size > 5 THEN p_size * 2.0 + p_retailprice / 100 END AS a2, CAST(p_partkey % 97 AS DOUBLE) AS a3, CAST(p_size % 2 AS DOUBLE) AS a4, CAST(length(p_name) AS DOUBLE) AS a5 FROM part)"
PC = ["a1", "p_retailprice", "a2", "a3", "a4", "a5"]


@query("att_pairwise_correlations", "ATT-04", f"WITH {PM} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM pm" for i, a in enumerate(PC) for b in PC[i + 1:]), "r")
def att_pairwise_correlations(spark, sf):
    return AT.pairwise_correlations(part_matrix(spark, sf), PC).drop("i", "j")


UNCORRELATED = f"""WITH {PM}, v AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS i, avg(CASE WHEN {c} IS NOT NULL AND {c} <> 0 THEN 1.0 ELSE 0 END) AS valid_fraction FROM pm" for i, c in enumerate(PC))}),
  c AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM pm" for i, a in enumerate(PC) for b in PC[i + 1:])}),
  m AS (SELECT b AS feature, max(abs(r)) AS max_abs_r FROM c JOIN v va ON va.feature = a AND va.valid_fraction >= 0.8 JOIN v vb ON vb.feature = b AND vb.valid_fraction >= 0.8 GROUP BY 1)
  SELECT feature, valid_fraction, max_abs_r, valid_fraction >= 0.8 AND NOT coalesce(max_abs_r > 0.75, false) AS keep FROM v LEFT JOIN m USING (feature)"""


@query("att_uncorrelated_features", "ATT-04", UNCORRELATED, "valid_fraction max_abs_r")
def att_uncorrelated_features(spark, sf):
    return AT.uncorrelated_features(part_matrix(spark, sf), PC)


FIXED_FEATURES = (PC[-1], PC[0], "not_a_column")


@query("att_combined_features", "ATT-05", f"""WITH u AS ({UNCORRELATED}) SELECT feature, feature IN {FIXED_FEATURES} AS fixed, keep AS selected FROM u WHERE keep OR feature IN {FIXED_FEATURES}""")
def att_combined_features(spark, sf):
    """Selected columns and those that are always kept, as far as the table has them."""
    m = part_matrix(spark, sf)
    return AT.combined_feature_table(AT.uncorrelated_features(m, PC), m.columns, FIXED_FEATURES)


def attr_frame(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("series_id"), F.col("c_mktsegment").alias("cluster"), (F.col("c_acctbal") / 10).alias("ele_mt_uav"),
                    (F.col("c_nationkey") * 30.0).alias("pre_mm_uyr"), (F.col("c_custkey") % 101).cast("double").alias("for_pc_use"))


AF = "af AS (SELECT CAST(c_custkey AS VARCHAR) AS series_id, c_mktsegment AS cluster, c_acctbal / 10 AS ele_mt_uav, c_nationkey * 30.0 AS pre_mm_uyr, CAST(c_custkey % 101 AS DOUBLE) AS for_pc_use FROM customer)"
AC = ["ele_mt_uav", "pre_mm_uyr", "for_pc_use"]


@query("att_cluster_labels", "ATT-06", f"""WITH {AF}, c AS (SELECT cluster, avg(ele_mt_uav) AS ev, avg(pre_mm_uyr) AS pv FROM af GROUP BY 1)
  SELECT cluster, CASE WHEN ev > 1000 THEN 'Highland' WHEN ev > 500 THEN 'Upland' ELSE 'Lowland' END || ' (' || printf('%.0f', ev) || 'm) / ' || CASE WHEN pv > 700 THEN 'Humid' WHEN pv < 400 THEN 'Semi-arid' ELSE 'Moderate' END || ' (' || printf('%.0f', pv) || 'mm/yr)' AS label FROM c""")
def att_cluster_labels(spark, sf):
    return AT.cluster_labels(CL.centroids_long(attr_frame(spark, sf), AC))


# ---- relations ----


def metric_frame(spark, sf, spread=F.stddev_samp):
    d = T.supplier_flow(spark, sf).groupBy("series_id").agg(F.avg("value").alias("q_mean"), spread("value").alias("q_std"), F.max("p").alias("p_max"))
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"), "s_acctbal", F.col("s_nationkey").alias("nation"))
    return d.join(s, "series_id")


MF = f"{T.SUPPLIER_SQL}, mf AS (SELECT series_id, q_mean, q_std, p_max, s_acctbal, s_nationkey AS nation FROM (SELECT series_id, avg(value) AS q_mean, stddev_samp(value) AS q_std, max(p) AS p_max FROM sup GROUP BY 1) JOIN supplier ON series_id = CAST(s_suppkey AS VARCHAR))"


# Spreads that are equal for equal values in any order, so that ranks of ties are not left to rounding.
RF = MF.replace("stddev_samp(value)", "CASE WHEN count(value) > 1 THEN sqrt(greatest(count(value) * sum(value * value) - sum(value) * sum(value), 0) / (count(value) * (count(value) - 1))) END")


@query("rel_boot_median_ci", "REL-01")
def rel_boot_median_ci(spark, sf):
    e = T.table(spark, sf, "events")
    return RL.boot_median_ci(e, ["event_type"], "value")


@query("rel_boot_spearman_ci", "REL-02")
def rel_boot_spearman_ci(spark, sf):
    m = metric_frame(spark, sf).withColumn("all", F.lit("all"))
    return RL.boot_spearman_ci(m, ["all"], "q_mean", "q_std")


def rank_sql(src, x, y, keys):
    p = f"PARTITION BY {keys}" if keys else ""
    pc = lambda c: f"PARTITION BY {keys + ', ' if keys else ''}{c}"
    return f"SELECT *, rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({pc(x)}) - 1) / 2.0 AS rx, rank() OVER ({p} ORDER BY {y}) + (count(*) OVER ({pc(y)}) - 1) / 2.0 AS ry FROM {src}"


@query("rel_spearman_network", "REL-02", f"WITH {RF}, r AS ({rank_sql('mf', 'q_mean', 'q_std', '')}) SELECT 'all' AS \"all\", corr(rx, ry) AS rho, count(*) AS n_pairs FROM r", "rho")
def rel_spearman_network(spark, sf):
    from ..functions.quantiles import spearman

    return spearman(metric_frame(spark, sf, std_from_sums).withColumn("all", F.lit("all")), ["all"], "q_mean", "q_std")


@query("rel_shape_bands", "REL-03", f"""WITH {MF}, s AS (SELECT median(q_mean) FILTER (WHERE s_acctbal < 2000) AS baseline_med, median(q_mean) FILTER (WHERE s_acctbal BETWEEN 3000 AND 5000) AS peak_med, median(q_mean) FILTER (WHERE s_acctbal > 7000) AS high_med,
   count(*) FILTER (WHERE s_acctbal < 2000) AS baseline_n, count(*) FILTER (WHERE s_acctbal BETWEEN 3000 AND 5000) AS peak_n, count(*) FILTER (WHERE s_acctbal > 7000) AS high_n FROM mf) SELECT *, peak_med > baseline_med AND peak_med > high_med AS hump FROM s""", "baseline_med peak_med high_med")
def rel_shape_bands(spark, sf):
    a = F.col("s_acctbal")
    return RL.shape_verdict(RL.shape_bands(metric_frame(spark, sf), "s_acctbal", "q_mean", {"baseline": a < 2000, "peak": a.between(3000, 5000), "high": a > 7000}))


@query("rel_sign_reversal", "REL-03", f"WITH {MF}, t AS (SELECT *, nation >= 12 AS ab FROM mf), r AS ({rank_sql('t', 's_acctbal', 'q_mean', 'ab')}), c AS (SELECT corr(rx, ry) FILTER (WHERE ab) AS rho_above, corr(rx, ry) FILTER (WHERE NOT ab) AS rho_below FROM r) SELECT *, rho_above * rho_below < 0 AS reversed FROM c", "rho_above rho_below")
def rel_sign_reversal(spark, sf):
    return RL.sign_reversal(metric_frame(spark, sf), F.col("nation") >= 12, "s_acctbal", "q_mean")


def stage_frame(spark, sf):
    return T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value"), F.col("p_a").alias("stage"))


def _stage(cond, name):
    return f"""{name}0 AS (SELECT series_id, gappy AS v, p_a AS s FROM forcing WHERE gappy IS NOT NULL AND p_a IS NOT NULL AND {cond}), {name}1 AS ({rank_sql(name + '0', 'v', 's', 'series_id')}), {name} AS (SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 365 THEN corr(rx, ry) END AS rho FROM {name}1 GROUP BY 1)"""


@query("rel_stage_consistency", "REL-04", f"WITH {T.FORCING_SQL}, {_stage('true', 'sa')}, {_stage('month(date) BETWEEN 5 AND 10', 'so')} SELECT sa.series_id, sa.n AS n_all, sa.rho AS rho_all, so.n AS n_open_water, so.rho AS rho_open_water, CASE WHEN so.rho IS NULL THEN -1 WHEN so.rho >= 0.5 THEN 0 ELSE 1 END AS screen FROM sa LEFT JOIN so USING (series_id)", "rho_all rho_open_water")
def rel_stage_consistency(spark, sf):
    return RL.stage_consistency(stage_frame(spark, sf))


@query("rel_stage_windows", "QC-18 REL-04", f"WITH {T.FORCING_SQL}, {_stage('month(date) BETWEEN 5 AND 10', 'sa')}, {_stage('month(date) BETWEEN 6 AND 9', 'so')} SELECT 'may_oct' AS \"window\", count(*) FILTER (WHERE rho < 0.75) AS n_weak FROM sa UNION ALL SELECT 'jun_sep', count(*) FILTER (WHERE rho < 0.75) FROM so")
def rel_stage_windows(spark, sf):
    return RL.stage_window_sensitivity(stage_frame(spark, sf), {"may_oct": (5, 6, 7, 8, 9, 10), "jun_sep": (6, 7, 8, 9)}, weak=0.75)


@query("rel_binned_median", "REL-05", f"""WITH {MF}, g AS (SELECT * FROM (VALUES (0, 500.0), (1, 1750.0), (2, 3750.0), (3, 7500.0), (4, 15000.0)) AS v(bin, center)), b AS (SELECT CASE WHEN x <= 1000 THEN 0 WHEN x <= 2500 THEN 1 WHEN x <= 5000 THEN 2 WHEN x <= 10000 THEN 3 ELSE 4 END AS bin, q_mean FROM (SELECT least(greatest(s_acctbal, 0), 20000) AS x, CASE WHEN nation <> 3 THEN q_mean END AS q_mean FROM mf))
  SELECT g.bin, center, count(q_mean) AS n, count(b.bin) - count(q_mean) AS n_missing, quantile_cont(q_mean, 0.25) AS q25, median(q_mean) AS median, quantile_cont(q_mean, 0.75) AS q75 FROM g LEFT JOIN b USING (bin) GROUP BY 1, 2""", "center q25 median q75")
def rel_binned_median(spark, sf):
    m = metric_frame(spark, sf).withColumn("q_mean", F.when(F.col("nation") != 3, F.col("q_mean")))
    return RL.binned_median(m, "s_acctbal", "q_mean", [0, 1000, 2500, 5000, 10000, 20000])


_TAGGED = "tg AS (SELECT mf.*, subset FROM mf, LATERAL (SELECT unnest(['all', CASE WHEN s_acctbal > 5000 THEN 'rich' END, CASE WHEN nation < 10 THEN 'north' END, CASE WHEN p_max <= (SELECT quantile_cont(p_max, 0.2) FROM mf) THEN 'lowest_fifth' END]) AS subset) WHERE subset IS NOT NULL)"


@query("rel_subset_spearman", "REL-06", f"""WITH {RF}, {_TAGGED}, r AS ({rank_sql('tg', 'q_mean', 'q_std', 'subset')}) SELECT subset, corr(rx, ry) AS rho, count(*) AS n_pairs FROM r GROUP BY 1""", "rho")
def rel_subset_spearman(spark, sf):
    """Rank correlation in overlapping subsets, one of them the lowest fifth by another metric."""
    m = metric_frame(spark, sf, std_from_sums)
    low = RL.lowest_share(m, "p_max").select("series_id", F.lit(True).alias("low"))
    tagged = m.join(low, "series_id", "left").withColumn("low", F.coalesce("low", F.lit(False)))
    return RL.subset_spearman(tagged, {"all": F.lit(True), "rich": F.col("s_acctbal") > 5000, "north": F.col("nation") < 10, "lowest_fifth": F.col("low")}, "q_mean", "q_std")


@query("rel_window_medians", "REL-06", f"""WITH {MF} SELECT w AS "window", count(q_mean) AS n, median(q_mean) AS median FROM mf JOIN (VALUES ('low', -1000.0, 2000.0), ('middle', 1500.0, 6000.0), ('high', 6000.0, 10000.0)) AS v(w, a, b) ON s_acctbal BETWEEN a AND b GROUP BY 1""", "median")
def rel_window_medians(spark, sf):
    return RL.window_medians(metric_frame(spark, sf), "s_acctbal", "q_mean", {"low": (-1000.0, 2000.0), "middle": (1500.0, 6000.0), "high": (6000.0, 10000.0)})


_SUB = {"all": "true", "rich": "s_acctbal > 5000", "north": "nation < 10"}
_SM = ("q_mean", "q_std", "p_max")


@query("rel_subset_summary", "REL-07", f"""WITH {MF}, l AS ({" UNION ALL ".join(f"SELECT '{s}' AS subset, '{m}' AS metric, {m} AS v FROM mf WHERE {c}" for s, c in _SUB.items() for m in _SM)})
  SELECT subset, metric, count(*) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max, quantile_cont(v, 0.1) AS p10, median(v) AS median, quantile_cont(v, 0.9) AS p90 FROM l GROUP BY 1, 2""", "mean min max p10 median p90")
def rel_subset_summary(spark, sf):
    return RL.subset_summary(metric_frame(spark, sf), {n: F.expr(c) for n, c in _SUB.items()}, list(_SM))


@query("rel_subset_flow", "REL-08", f"WITH {MF} SELECT 1 AS step, 'all' AS subset, count(*) AS n FROM mf UNION ALL SELECT 2, 'rich', count(*) FILTER (WHERE s_acctbal > 5000) FROM mf UNION ALL SELECT 3, 'rich_north', count(*) FILTER (WHERE s_acctbal > 5000 AND nation < 10) FROM mf")
def rel_subset_flow(spark, sf):
    a, b = F.col("s_acctbal") > 5000, F.col("nation") < 10
    return RL.subset_flow(metric_frame(spark, sf), {"all": F.lit(True), "rich": a, "rich_north": a & b})


_SEASON_SHARES = ", ".join(f"avg(CASE WHEN month(date) IN {m} THEN CASE WHEN gappy IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS {n}" for n, m in (("winter", (12, 1, 2)), ("spring", (3, 4, 5)), ("summer", (6, 7, 8)), ("autumn", (9, 10, 11))))


@query("rel_strict_subset", "REL-09", "WITH " + period_sql(T.FORCING_SQL, "gappy") + f""", se AS (SELECT series_id, {_SEASON_SHARES} FROM forcing GROUP BY 1),
  co AS (SELECT series_id, count(mean_discharge) AS n_mean_discharge, count(fdc_slope) AS n_fdc_slope FROM pm GROUP BY 1),
  ok AS (SELECT *, least(coalesce(winter, 0), coalesce(spring, 0), coalesce(summer, 0), coalesce(autumn, 0)) >= 0.7 AS season_complete, least(coalesce(n_mean_discharge, 0), coalesce(n_fdc_slope, 0)) >= 5 AS metric_complete FROM se LEFT JOIN co USING (series_id))
  SELECT *, season_complete AND metric_complete AS strict FROM ok""", "winter spring summer autumn")
def rel_strict_subset(spark, sf):
    d = T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value"))
    return RL.strict_subset(d, SG.period_metrics(d), ["mean_discharge", "fdc_slope"])


@query("rel_grade_shares", "REL-10", f"WITH {OV} SELECT overall AS label, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM ov) AS pct FROM ov GROUP BY 1", "pct")
def rel_grade_shares(spark, sf):
    return RL.share_table(_grades(spark, sf), "overall_grade")


def id_sources(spark, sf):
    s = lambda t, c: T.table(spark, sf, t).select(F.col(c).cast("string").alias("series_id"))
    return {"supplier": s("supplier", "s_suppkey"), "customer": s("customer", "c_custkey"), "shipped": s("lineitem", "l_suppkey")}


_IDS = "ids AS (SELECT 'supplier' AS source, CAST(s_suppkey AS VARCHAR) AS id FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'shipped', CAST(l_suppkey AS VARCHAR) FROM lineitem)"


@query("rel_id_audit", "REL-11", f"WITH {_IDS} SELECT source, count(*) AS n, count(DISTINCT id) AS n_unique, count(*) - count(DISTINCT id) AS n_duplicate_rows, CAST(min(length(id)) AS INTEGER) AS min_length, CAST(max(length(id)) AS INTEGER) AS max_length, count(*) FILTER (WHERE length(id) >= 2) AS n_long FROM ids GROUP BY 1")
def rel_id_audit(spark, sf):
    return RL.id_audit(id_sources(spark, sf), long_length=2)


@query("rel_id_membership", "REL-11", f"WITH {_IDS} SELECT id, CAST(max(CASE WHEN source = 'supplier' THEN 1 ELSE 0 END) AS INTEGER) AS in_supplier, CAST(max(CASE WHEN source = 'customer' THEN 1 ELSE 0 END) AS INTEGER) AS in_customer, CAST(max(CASE WHEN source = 'shipped' THEN 1 ELSE 0 END) AS INTEGER) AS in_shipped FROM ids WHERE length(id) >= 2 GROUP BY 1")
def rel_id_membership(spark, sf):
    return RL.id_membership(id_sources(spark, sf), long_length=2)


# ---- clustering ----


def vectors(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("series_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("cluster"))


@query("clu_silhouettes", "CLU-01", """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT a.id, a.label AS c, b.label AS k, avg(list_distance(a.x, b.x) ** 2) AS m, sum(list_distance(a.x, b.x) ** 2) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
  p AS (SELECT id, c, max(CASE WHEN k = c THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN k <> c THEN m END) AS b, max(CASE WHEN k = c THEN n END) AS n FROM d GROUP BY 1, 2)
  SELECT id AS series_id, c AS cluster, CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM p""", "silhouette")
def clu_silhouettes(spark, sf):
    return CL.silhouettes(vectors(spark, sf))


@query("clu_silhouette_sweep", "CLU-01")
def clu_silhouette_sweep(spark, sf):
    return CL.silhouette_sweep(vectors(spark, sf).drop("cluster"))


@query("clu_regimes", "CLU-02")
def clu_regimes(spark, sf):
    r = CL.regimes(vectors(spark, sf).drop("cluster"), k=8)
    return r.groupBy("regime").agg(F.count("*").alias("n"))


@query("clu_relabel_by_size", "CLU-02", "SELECT c_nationkey AS cluster, CAST(row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS INTEGER) AS regime, count(*) AS n FROM customer GROUP BY 1")
def clu_relabel_by_size(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("cluster"))
    return CL.relabel_by_size(c).groupBy("cluster", "regime").agg(F.count("*").alias("n"))


@query("clu_end_members", "CLU-03")
def clu_end_members(spark, sf):
    e = CL.end_members(vectors(spark, sf).drop("cluster"), min_size=20)
    return e.groupBy("end_member").agg(F.count("*").alias("n"), F.avg("membership").alias("mean_membership"))


@query("clu_stability", "CLU-03")
def clu_stability(spark, sf):
    v = vectors(spark, sf).drop("cluster")
    return CL.stability(v, CL.end_members(v, min_size=20), rounds=20, min_size=20)


@query("clu_prepared_components", "CLU-03")
def clu_prepared_components(spark, sf):
    m = metric_frame(spark, sf)
    cols = ["q_mean", "q_std", "p_max", "s_acctbal"]
    z = CL.normal_scores(CL.impute_medians(m, cols), cols)
    pc, _ = CL.principal_components(CL.as_vectors(z, cols))
    from pyspark.ml.functions import vector_to_array

    return pc.select("series_id", F.size(vector_to_array("features")).alias("n_components"))


@query("clu_profiles", "CLU-04", f"""WITH {AF}, z AS (SELECT *, {', '.join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z{i}" for i, c in enumerate(AC))} FROM af)
  SELECT cluster, count(*) AS n, {', '.join(f"avg(z{i}) AS z_{c}, median({c}) AS median_{c}" for i, c in enumerate(AC))} FROM z GROUP BY 1""", " ".join(f"{x}_{c}" for x in ("z", "median") for c in AC))
def clu_profiles(spark, sf):
    return CL.profiles(attr_frame(spark, sf), AC)


_ARI = """n AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS c FROM {t} GROUP BY 1, 2), q AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM n) AS ij, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM n GROUP BY a)) AS i,
   (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM n GROUP BY b)) AS j, (SELECT sum(c) FROM n) AS n), ar AS (SELECT (ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)) AS ari, CAST(n AS BIGINT) AS n FROM q)""".format


@query("clu_adjusted_rand", "CLU-05", f"WITH {_ARI(a='lang', b='source', t='documents')} SELECT * FROM ar", "ari")
def clu_adjusted_rand(spark, sf):
    return CL.adjusted_rand(T.table(spark, sf, "documents"), "lang", "source")


@query("clu_concordance", "CLU-05", f"WITH {_ARI(a='event_type', b='user_id', t='events')}, m AS (SELECT a, max(c) AS m, sum(c) AS t FROM n GROUP BY 1) SELECT sum(m) / sum(t) AS concordant, count(*) AS n_groups, (SELECT ari FROM ar) AS ari, (SELECT n FROM ar) AS n FROM m", "concordant ari")
def clu_concordance(spark, sf):
    return CL.concordance(T.table(spark, sf, "events"), "event_type", "user_id")


# The minimum sizes of the published sweep, and the number of sites that they were chosen for.
MIN_SIZES, SIZED_FOR = (25, 30, 40, 50, 60, 80), 2746


@query("clu_granularity_sweep", "CLU-06")
def clu_granularity_sweep(spark, sf):
    v = vectors(spark, sf).drop("cluster")
    n = v.count()
    return CL.granularity_sweep(v, CL.regimes(v, k=6), [max(2, -(-s * n // SIZED_FOR)) for s in MIN_SIZES])


def sized(n: int, size: int = 40) -> int:
    """A minimum size in proportion to the number of sites that it was chosen for."""
    return max(2, -(-size * n // SIZED_FOR))


@query("clu_ward_regimes", "CLU-02")
def clu_ward_regimes(spark, sf):
    return HI.ward_regimes(vectors(spark, sf), k=15).groupBy("regime").agg(F.count("*").alias("n"))


@query("clu_density_members", "CLU-03")
def clu_density_members(spark, sf):
    v = vectors(spark, sf)
    return HI.density_members(v, sized(v.count())).select("series_id", "end_member", F.round("membership", 6).alias("membership"))


@query("clu_density_stability", "CLU-03")
def clu_density_stability(spark, sf):
    v = vectors(spark, sf)
    m = sized(v.count())
    return HI.density_stability(v, stash(HI.density_members(v, m), "density-members"), min_size=m)


@query("clu_density_sweep", "CLU-06")
def clu_density_sweep(spark, sf):
    v = vectors(spark, sf)
    n = v.count()
    return HI.density_sweep(v, stash(HI.ward_regimes(v, k=15), "ward-regimes"), [sized(n, s) for s in MIN_SIZES])


@query("clu_min_max", "CLU-07", f"WITH {AF} SELECT series_id, {', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}' for c in AC)} FROM af", " ".join(AC))
def clu_min_max(spark, sf):
    return CL.min_max(attr_frame(spark, sf), AC)


@query("clu_centroids", "CLU-07", f"""WITH {AF}, s AS (SELECT cluster, {', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS n{i}, {c}' for i, c in enumerate(AC))} FROM af)
  {" UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, avg(n{i}) AS norm, avg({c}) AS raw FROM s GROUP BY 1" for i, c in enumerate(AC))}""", "norm raw")
def clu_centroids(spark, sf):
    return CL.centroids_long(attr_frame(spark, sf), AC)


# ---- validation ----


@query("val_compare_series", "VAL-01", f"""WITH {T.FORCING_SQL}, x AS (SELECT series_id, date, p_b AS v, p_a AS r FROM forcing WHERE p_a IS NOT NULL AND p_b IS NOT NULL)
  SELECT series_id, count(*) AS overlap_days, min(date) AS overlap_start, max(date) AS overlap_end, round(corr(v, r), 4) AS r, round(1 - sum((v - r) ** 2) / (var_pop(r) * count(*)), 4) AS nse, round(100 * sum(v - r) / sum(r), 1) AS pbias,
   round(sqrt(avg((v - r) ** 2)), 2) AS rmse, round(avg(r), 1) AS reference_mean, round(avg(v), 1) AS value_mean FROM x GROUP BY 1""", "r nse pbias rmse reference_mean value_mean", "overlap_start overlap_end")
def val_compare_series(spark, sf):
    f = T.forcing(spark, sf).select("series_id", "date", F.col("p_b").alias("value"), F.col("p_a").alias("reference"))
    return VA.compare_series(f)


@query("val_external", "VAL-02")
def val_external(spark, sf):
    st, s = match_input(spark, sf)
    orders = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    own = T.supplier_flow(spark, sf).select(F.col("series_id").cast("long").alias("id"), "date", "value")
    return VA.validate_external(st, s, orders, own)


@query("val_external_records", "VAL-02", f"""WITH mt AS (SELECT station_id, site_id FROM ({REGISTRY['spa_match_sites'].sql})), {T.SUPPLIER_SQL},
  od AS (SELECT CAST(series_id AS BIGINT) AS station_id, date, p AS r FROM sup), ow AS (SELECT CAST(series_id AS BIGINT) AS site_id, date, value AS v FROM sup),
  x AS (SELECT * FROM mt JOIN od USING (station_id) JOIN ow USING (site_id, date) WHERE r IS NOT NULL AND v IS NOT NULL),
  g AS (SELECT station_id, site_id, count(*) AS n, min(date) AS overlap_start, max(date) AS overlap_end, CASE WHEN var_pop(r) > 0 AND var_pop(v) > 0 THEN corr(v, r) END AS c, sum((v - r) ** 2) AS ss, var_pop(r) * count(*) AS tot, sum(r) AS sr, sum(v - r) AS d, avg(r) AS mr, avg(v) AS mv FROM x GROUP BY 1, 2)
  SELECT station_id, site_id, n AS overlap_days, overlap_start, overlap_end, CASE WHEN n >= 30 THEN round(c, 4) END AS r, CASE WHEN n >= 30 AND tot > 0 THEN round(1 - ss / tot, 4) END AS nse, CASE WHEN n >= 30 AND sr > 0 THEN round(100 * d / sr, 1) END AS pbias,
   CASE WHEN n >= 30 THEN round(sqrt(ss / n), 2) END AS rmse, CASE WHEN n >= 30 THEN round(mr, 1) END AS reference_mean, CASE WHEN n >= 30 THEN round(mv, 1) END AS value_mean FROM g""", "r nse pbias rmse reference_mean value_mean", "overlap_start overlap_end")
def val_external_records(spark, sf):
    """Stations whose records share enough days with their site: those with a series of shipments of their own."""
    st, s = match_input(spark, sf)
    d = T.supplier_flow(spark, sf).select(F.col("series_id").cast("long").alias("id"), "date", "value", "p")
    return VA.validate_external(st, s, d.select("id", "date", F.col("p").alias("value")), d.select("id", "date", "value"))


# Columns of the audited table: type in Spark, then units, long name and source as far as they are given.
AUDITED = (("series_id", "string", "1", "site", "register"), ("date", "date", "", "", ""), ("value", "double", "mm", "flow", "gauges"), ("gappy", "double", "mm", "flow with gaps", ""))


@query("val_column_audit", "VAL-06", f"""WITH {T.FORCING_SQL}, a AS ({" UNION ALL ".join(f"SELECT '{c}' AS column, '{t}' AS type, '{u}' AS units, '{n}' AS long_name, '{o}' AS source, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM forcing" for c, t, u, n, o in AUDITED)})
  SELECT *, concat_ws(',', CASE WHEN units = '' THEN 'units' END, CASE WHEN long_name = '' THEN 'long_name' END, CASE WHEN source = '' THEN 'source' END) AS missing, units <> '' AND long_name <> '' AND source <> '' AS ok FROM a""")
def val_column_audit(spark, sf):
    """Units, names and sources of a release table's columns, with their rows and nulls."""
    meta = {c: {k: v for k, v in zip(("units", "long_name", "source"), said) if v} for c, _, *said in AUDITED}
    return VA.column_audit(VA.with_metadata(T.forcing(spark, sf).select(*meta), meta))


@query("val_table_diff", "VAL-03", f"""WITH {T.FORCING_SQL}, o AS (SELECT series_id, date, gappy AS v FROM forcing WHERE date < DATE '2001-01-01'), n AS (SELECT series_id, date, CASE WHEN t > 5 THEN value ELSE gappy END AS v FROM forcing WHERE date >= DATE '1995-06-01'),
   j AS (SELECT o.date AS od, n.date AS nd, o.v AS ov, n.v AS nv FROM o FULL JOIN n USING (series_id, date))
  SELECT count(*) FILTER (WHERE od IS NULL) AS n_added, count(*) FILTER (WHERE nd IS NULL) AS n_removed, count(*) FILTER (WHERE od IS NOT NULL AND nd IS NOT NULL AND ov IS DISTINCT FROM nv) AS n_changed, count(*) FILTER (WHERE od IS NOT NULL AND nd IS NOT NULL AND ov IS NOT DISTINCT FROM nv) AS n_equal, false AS identical FROM j""")
def val_table_diff(spark, sf):
    f = T.forcing(spark, sf)
    old = f.where("date < DATE'2001-01-01'").select("series_id", "date", F.col("gappy").alias("v"))
    new = f.where("date >= DATE'1995-06-01'").select("series_id", "date", F.when(F.col("t") > 5, F.col("value")).otherwise(F.col("gappy")).alias("v"))
    return VA.table_diff(old, new, ["series_id", "date"])


@query("val_exact_revision", "VAL-03", "SELECT lang, source, CAST(n AS BIGINT) AS n, side FROM (SELECT lang, source, count(*) AS n, 'old' AS side FROM documents GROUP BY 1, 2 EXCEPT ALL SELECT lang, source, count(*) AS n, 'old' FROM documents WHERE n_chars > 100 GROUP BY 1, 2) UNION ALL (SELECT lang, source, count(*) AS n, 'new' AS side FROM documents WHERE n_chars > 100 GROUP BY 1, 2 EXCEPT ALL SELECT lang, source, count(*) AS n, 'new' FROM documents GROUP BY 1, 2)")
def val_exact_revision(spark, sf):
    d = T.table(spark, sf, "documents")
    n = lambda x: x.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return VA.exact_revision(n(d), n(d.where("n_chars > 100")))


def _long_stats(df, cols):
    return df.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], list(cols), "metric", "value")


@query("val_metric_check", "VAL-04", f"WITH {T.FORCING_SQL} SELECT 'p_a' AS metric, avg(p_a) AS expected, avg(p_a) AS actual, true AS ok FROM forcing UNION ALL SELECT 'p_b', avg(p_b), avg(p_b * 1.5), false FROM forcing UNION ALL SELECT 'p_c', avg(p_c), avg(p_c), true FROM forcing", "expected actual")
def val_metric_check(spark, sf):
    f = T.forcing(spark, sf)
    cols = ["p_a", "p_b", "p_c"]
    return VA.metric_check(_long_stats(f, cols), _long_stats(f.withColumn("p_b", F.col("p_b") * 1.5), cols), tolerance=1e-6)


@query("val_range_gates", "VAL-05", f"""WITH {T.FORCING_SQL}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS v FROM forcing" for c in ("value", "gappy", "t", "pet"))})
  SELECT metric, min(v) AS min, max(v) AS max, CAST(floor(min(v)) AS BIGINT) AS bound_low, CAST(ceil(max(v)) AS BIGINT) AS bound_high, count(*) FILTER (WHERE v < 0) * 100.0 / count(v) AS negative_pct, count(v) * 100.0 / count(*) AS coverage_pct FROM l GROUP BY 1""", "min max negative_pct coverage_pct")
def val_range_gates(spark, sf):
    return VA.range_gates(T.forcing(spark, sf), ["value", "gappy", "t", "pet"])


@query("val_gap_extent", "VAL-05", f"WITH {T.FORCING_SQL} SELECT count(DISTINCT date) AS n_gap_days, count(DISTINCT series_id) AS n_gap_series FROM forcing WHERE gappy IS NULL")
def val_gap_extent(spark, sf):
    return VA.gap_extent(T.forcing(spark, sf), "gappy")


_PG = {"value": (0.0, 60.0), "gappy": (0.0, 60.0), "t": (-20.0, 15.0), "pet": (0.0, 100.0)}


@query("val_percentile_gates", "VAL-05", f"""WITH {T.FORCING_SQL}, g AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {a}, {b})" for c, (a, b) in _PG.items())}) AS v(metric, low, high)), l AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS v FROM forcing" for c in _PG)}),
  q AS (SELECT metric, quantile_cont(v, 0.01) AS p01, median(v) AS p50, quantile_cont(v, 0.99) AS p99 FROM l GROUP BY 1) SELECT metric, p01, p50, p99, p01 >= low AND p99 <= high AS ok FROM q JOIN g USING (metric)""", "p01 p50 p99")
def val_percentile_gates(spark, sf):
    return VA.percentile_gates(T.forcing(spark, sf), _PG)


@query("val_screen_overlap", "VAL-07", f"WITH {MF} SELECT count(*) FILTER (WHERE q_mean > 29) AS n_violations, count(*) FILTER (WHERE q_mean > 29 AND s_acctbal > 5000) AS n_rich, count(*) FILTER (WHERE q_mean > 29 AND nation < 10) AS n_north, count(*) FILTER (WHERE q_mean > 29 AND NOT (s_acctbal > 5000) AND NOT (nation < 10)) AS n_uncaught FROM mf")
def val_screen_overlap(spark, sf):
    return VA.screen_overlap(metric_frame(spark, sf), {"rich": F.col("s_acctbal") > 5000, "north": F.col("nation") < 10}, F.col("q_mean") > 29)


@query("val_grades_of_flagged", "VAL-07", f"WITH {OV} SELECT overall AS overall_grade, count(*) AS n FROM ov SEMI JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS series_id FROM supplier WHERE s_acctbal > 5000) s USING (series_id) GROUP BY 1")
def val_grades_of_flagged(spark, sf):
    return VA.grades_of_flagged(metric_frame(spark, sf).where("s_acctbal > 5000"), _grades(spark, sf))


@query("val_uncaught", "VAL-07", f"WITH {MF} SELECT series_id FROM mf WHERE q_mean > 29 AND NOT (s_acctbal > 5000)")
def val_uncaught(spark, sf):
    m = metric_frame(spark, sf)
    return VA.uncaught(m.where("q_mean > 29").select("series_id"), m.where("s_acctbal > 5000"))


@query("val_code_shares", "VAL-09", "SELECT l_linestatus AS code, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM lineitem) AS pct FROM lineitem GROUP BY 1", "pct")
def val_code_shares(spark, sf):
    return VA.code_shares(T.table(spark, sf, "lineitem"), "l_linestatus")


@query("val_split_total", "VAL-09", "SELECT l_returnflag, count(*) AS parts, count(*) AS total, true AS ok FROM lineitem GROUP BY 1")
def val_split_total(spark, sf):
    li = T.table(spark, sf, "lineitem")
    n = lambda *k: li.groupBy(*k).agg(F.count("*").alias("n"))
    return VA.split_total(n("l_returnflag", "l_linestatus"), n("l_returnflag"), ["l_returnflag"])


@query("val_manifest_check", "VAL-10", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN n_chars > 2000 AND lang = 'en' THEN 'missing' WHEN n_chars > 2000 THEN 'changed' WHEN lang = 'de' THEN 'unlisted' ELSE 'ok' END AS status FROM documents WHERE NOT (lang = 'de' AND n_chars > 2000) UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unlisted' FROM documents WHERE lang = 'de' AND n_chars > 2000")
def val_manifest_check(spark, sf):
    d = T.table(spark, sf, "documents")
    digest = F.sha2("text", 256)
    files = d.where("NOT (n_chars > 2000 AND lang = 'en')").select(F.col("doc_id").cast("string").alias("path"), digest.alias("digest"))
    man = d.where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("n_chars") > 2000, "old").otherwise(digest).alias("digest"))
    return VA.manifest_check(files, man)


@query("val_series_id_alias", "VAL-11", "SELECT CAST(s_suppkey AS VARCHAR) AS series_id, s_acctbal FROM supplier", "s_acctbal")
def val_series_id_alias(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Gauge-ID"), "s_acctbal")
    return VA.with_series_id(s)


@query("val_equal_width_classes", "VAL-12", """WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), b AS (SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 6)), 5) AS INTEGER) AS bin, count(*) AS n FROM customer CROSS JOIN e GROUP BY 1)
  SELECT g.bin, lo + g.bin * ((hi - lo) / 6) AS low, lo + (g.bin + 1) * ((hi - lo) / 6) AS high, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(6)) AS INTEGER) AS bin) g CROSS JOIN e LEFT JOIN b USING (bin)""", "low high")
def val_equal_width_classes(spark, sf):
    return VA.equal_width_classes(T.table(spark, sf, "customer"), "c_acctbal")


# ---- release tables ----


@query("src_complete_calendar", "SRC-06", f"""WITH {T.SUPPLIER_SQL}, c AS (SELECT series_id, CAST(unnest(generate_series(DATE '1992-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT series_id FROM sup))
  SELECT c.series_id, c.date, value AS p_a, p AS p_b, round(count(value) OVER w * 100.0 / count(*) OVER w, 0) AS availability FROM c LEFT JOIN sup s ON s.series_id = c.series_id AND s.date = c.date WINDOW w AS (PARTITION BY c.series_id)""", "p_a p_b availability", "date")
def src_complete_calendar(spark, sf):
    d = T.supplier_flow(spark, sf)
    return RS.complete_calendar(d.select("series_id", "date", "value"), d.select("series_id", "date", F.col("p").alias("value")), "1992-01-01", "1998-12-31")


@query("src_common_ids", "SRC-07", "SELECT CAST(s_suppkey AS VARCHAR) AS series_id FROM supplier INTERSECT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0")
def src_common_ids(spark, sf):
    s = id_sources(spark, sf)
    return RS.common_ids(s["supplier"], T.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("series_id")))


@query("src_choose_source", "SRC-09", f"WITH {T.FORCING_SQL} SELECT series_id, date, CASE WHEN series_id IN ('AF', 'RO') THEN value ELSE gappy END AS v FROM forcing", "v", "date")
def src_choose_source(spark, sf):
    f = T.forcing(spark, sf)
    notes = f.select("series_id").distinct().where("series_id IN ('AF', 'RO')")
    return RS.choose_source(f.select("series_id", "date", F.col("gappy").alias("v")), f.select("series_id", "date", F.col("value").alias("v")), notes, ["v"])


@query("src_release_flow", "SRC-10", f"""WITH {T.FORCING_SQL} SELECT series_id, date, gappy / 10 AS q_mm, CASE WHEN series_id LIKE 'A%' THEN gappy ELSE value END AS q_cms,
   CASE WHEN (CASE WHEN series_id LIKE 'A%' THEN gappy ELSE value END) IS NULL THEN 3 WHEN gappy IS NULL THEN 1 ELSE 0 END AS quality_flag, CASE WHEN m > 20 THEN 1 ELSE 0 END AS anomaly
  FROM forcing JOIN (SELECT series_id, median(gappy / 10) AS m FROM forcing GROUP BY 1) USING (series_id)""", "q_mm q_cms", "date")
def src_release_flow(spark, sf):
    f = T.forcing(spark, sf).withColumn("q_mm", F.col("gappy") / 10)
    prim = f.where("series_id LIKE 'A%'").withColumn("q_cms", F.col("gappy"))
    back = f.withColumn("q_cms", F.col("value"))
    masks = IN.fill_mask(f.select("series_id", "date", F.col("gappy").alias("value")), f.select("series_id", "date", "value"))
    anomaly = IN.specific_anomaly(f.select("series_id", F.col("q_mm").alias("value")))
    return RS.release_flow(prim, back, masks, anomaly).withColumn("quality_flag", F.col("quality_flag").cast("int"))


@query("src_release_forcing", "SRC-11", f"WITH {T.FORCING_SQL} SELECT series_id, date, p_a, p_b, t FROM forcing", "p_a p_b t", "date")
def src_release_forcing(spark, sf):
    f = T.forcing(spark, sf)
    one = lambda c: f.where(F.col(c).isNotNull()).select("series_id", "date", F.col(c).alias("value"))
    return RS.release_forcing(f, {"p_a": one("p_a"), "p_b": one("p_b"), "t": one("t")})


@query("src_release_level", "SRC-12 SRC-13", f"""WITH {T.FORCING_SQL}, x AS (SELECT series_id, date, CASE WHEN series_id LIKE 'R%' THEN gappy ELSE value END AS l, CASE WHEN series_id LIKE 'R%' THEN 0 ELSE 1 END AS ty FROM forcing)
  SELECT series_id, date, l AS lvl_cm, 7.5 + l / 100 AS lvl_abs, 7.5 AS datum, CASE WHEN l IS NULL THEN 3 ELSE 0 END AS quality_flag, ty AS site_type, -1 AS screen FROM x""", "lvl_cm lvl_abs datum", "date")
def src_release_level(spark, sf):
    f = T.forcing(spark, sf)
    river = f.where("series_id LIKE 'R%'").select("series_id", "date", F.col("gappy").alias("lvl_cm"))
    res = f.select("series_id", "date", F.col("value").alias("lvl_cm"))
    ids = f.select("series_id").distinct()
    datum = RS.overwrite_datums(ids.withColumn("datum", F.lit(1.0)), ids.withColumn("datum", F.lit(7.5)))
    masks = f.select("series_id", "date", F.lit(0).cast("tinyint").alias("fill_mask"))
    screen = ids.withColumn("screen", F.lit(None).cast("int"))
    return RS.release_level(river, res, datum, masks, screen)


@query("src_recommended_columns", "SRC-01 SRC-14", "SELECT CAST(s_suppkey AS VARCHAR) AS series_id, s_acctbal FROM supplier", "s_acctbal")
def src_recommended_columns(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"), "s_acctbal", "s_nationkey")
    return RS.recommended_columns(s, [("s_acctbal", True), ("s_nationkey", False)])


@query("src_observed_only", "SRC-15", "SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN min(l_tax) < 0.06 AND max(l_tax) > 0.01 THEN sum(l_quantity) END AS value FROM lineitem GROUP BY 1, 2", "value", "date")
def src_observed_only(spark, sf):
    d = T.daily_sum(T.table(spark, sf, "lineitem"), F.col("l_suppkey"), F.col("l_shipdate"), value=F.sum("l_quantity"),
                    quality_flag=F.when((F.min("l_tax") < 0.06) & (F.max("l_tax") > 0.01), 0).otherwise(1))
    return RS.observed_only(d).drop("quality_flag")


@query("src_id_report", "SRC-16", "SELECT 0 AS n_null, 0 AS n_blank, count(*) AS n_duplicated FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def src_id_report(spark, sf):
    return RS.id_report(T.table(spark, sf, "lineitem"), "l_suppkey")


def station_lines(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), "o_orderstatus", "o_orderdate", "o_totalprice")
    head = o.select("file").distinct().select("file", F.explode(F.array(F.lit("# Country: "), F.lit("# Station: "), F.lit("# comment"))).alias("h"))
    head = head.select("file", F.when(F.col("h").contains("Country"), F.concat("h", F.when(F.col("file") < "4", "RU").otherwise("FI"))).when(F.col("h").contains("Station"), F.concat("h", "file")).otherwise(F.col("h")).alias("line"))
    v = F.when(F.col("o_orderstatus") == "P", "-999").otherwise(F.format_string("%.2f", "o_totalprice"))
    body = o.select("file", F.concat_ws(";", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("--:--"), v).alias("line"))
    return head.unionByName(body)


@query("src_station_bodies", "SRC-18", "SELECT o_orderpriority AS file, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders", "value", "date")
def src_station_bodies(spark, sf):
    return RS.parse_station_lines(station_lines(spark, sf))[1]


@query("src_active_stations", "SRC-19", "SELECT o_orderpriority AS file, 'RU' AS country, o_orderpriority AS station, max(CAST(o_orderdate AS DATE)) AS last_date, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_values FROM orders WHERE o_orderpriority < '4' GROUP BY 1 HAVING max(o_orderdate) >= DATE '2001-01-01'", "", "last_date")
def src_active_stations(spark, sf):
    head, body = RS.parse_station_lines(station_lines(spark, sf))
    return RS.stations_in_country(head, body, "RU", "2001-01-01")[0]


@query("src_grade_map", "SRC-20", "SELECT event_type AS grade, CAST(user_id AS VARCHAR) AS series_id FROM events GROUP BY 1, 2")
def src_grade_map(spark, sf):
    e = T.table(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("u")).distinct()
    one = F.to_json(F.create_map("event_type", F.array("u")))
    return RS.grade_map(e.select(one.alias("json")))


@query("src_attach_notes", "SRC-21", f"WITH {OV} SELECT series_id, overall AS overall_grade, CASE WHEN s_acctbal > 5000 THEN 'filled ' || series_id ELSE '' END AS note FROM ov JOIN supplier ON series_id = CAST(s_suppkey AS VARCHAR)")
def src_attach_notes(spark, sf):
    notes = T.table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("series_id"), F.concat(F.lit("filled "), "s_suppkey").alias("note"))
    return RS.attach_notes(_grades(spark, sf).select("series_id", "overall_grade"), notes)


@query("src_orphan_notes", "SRC-21", "SELECT CAST(c_custkey AS VARCHAR) AS series_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def src_orphan_notes(spark, sf):
    s = id_sources(spark, sf)
    return RS.orphan_notes(s["supplier"], s["customer"])


@query("sig_paper_table", "SIG-42 SIG-43")
def sig_paper_table(spark, sf):
    f = T.forcing(spark, sf).withColumn("value", F.col("gappy")).withColumn("p", F.col("p_a"))
    area = f.select("series_id").distinct().withColumn("area_km2", F.length("series_id") * 20.0)
    return SG.paper_table(f, area, window=("1995-10-01", "2001-09-30"))


# ---- streams over the event table ----


def event_stream(spark, sf):
    e = ST.read_stream(spark, sf, "events.parquet")
    return e.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("str_daily_extremes", "STR-04 ING-31", """SELECT event_type AS series_id, CAST(ts AS DATE) AS date, avg(value) AS t_mean, min(value) AS t_min, max(value) AS t_max FROM events GROUP BY 1, 2
  HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""", "t_mean t_min t_max", "date")
def str_daily_extremes(spark, sf):
    return ST.run_available(ST.daily_extremes(event_stream(spark, sf)), ST.scratch(spark))


@query("str_healed_days", "STR-03", """SELECT event_type AS series_id, CAST(ts AS DATE) AS date, max(value) AS value FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)""", "value", "date")
def str_healed_days(spark, sf):
    return ST.run_available(ST.healed_days(event_stream(spark, sf)), ST.scratch(spark))


@query("str_closing_periods", "STR-01", """WITH w AS (SELECT CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 864000) AS BIGINT) AS k, count(*) AS n, sum(value) AS total FROM events GROUP BY 1) SELECT CAST(make_timestamp(CAST(k * 864000 * 1000000 AS BIGINT)) AS DATE) AS period_start, n, total FROM w WHERE (k + 1) * 864000 <= (SELECT max(epoch(CAST(ts AS TIMESTAMP))) - 2 * 86400 FROM events)""", "total", "period_start")
def str_closing_periods(spark, sf):
    return ST.run_available(ST.closing_periods(event_stream(spark, sf), delay="2 days"), ST.scratch(spark))


@query("str_wet_sessions", "STR-06", """WITH w AS (SELECT event_type AS series_id, CAST(ts AS TIMESTAMP) AS ts, value FROM events WHERE value >= 100),
  o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM w),
  g AS (SELECT *, sum(b) OVER (PARTITION BY series_id ORDER BY ts) AS s FROM o)
  SELECT series_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS "start", count(*) AS n, sum(value) AS total FROM g GROUP BY series_id, s HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM w)""", "total")
def str_wet_sessions(spark, sf):
    out = ST.run_available(ST.wet_sessions(event_stream(spark, sf), 100.0, gap="12 hours"), ST.scratch(spark))
    return out.select("series_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")
