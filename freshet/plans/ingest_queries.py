"""Queries for ingest, gap filling, provenance, id scope and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import filters as FL
from ..operators import ingest as IN
from ..operators import spatial as SP
from ..sources import tables as T
from .meteo_queries import area_sql
from .quality_queries import SUPY, overall_cte, supplier_years
from .registry import query

# ---- sheet blocks ----
# Daily totals are written out as cell text with a decimal comma, blanks, lone dots and codes, in
# blocks of one series and year, and read back.


def sheet_rows(spark, sf):
    """Sheet rows ``(file, row, c1…c12)``: header lines then 31 day lines per block."""
    d = T.flow(spark, sf).select(
        "series_id", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), "value"
    )
    v = F.col("value")
    text = (
        F.when(v == 77, ".").when(v == 88, "прмз").when((v == 500) & (F.col("month") == 7), "1.2.3")
        .otherwise(F.concat(v.cast("long").cast("string"), F.lit(",5 ")))
    )
    body = d.groupBy("series_id", "year", "day").pivot("month", list(range(1, 13))).agg(F.first(text))
    first = 1995
    at = (F.col("year") - first) * 47
    cells = body.select("series_id", (at + 8 + F.col("day")).alias("row"), *[F.col(str(i)).alias(f"c{i}") for i in range(1, 13)])
    none = [F.lit(None).cast("string").alias(f"c{i}") for i in range(2, 13)]
    heads = F.array(
        F.struct(F.lit(4).alias("o"), F.col("series_id").alias("c1")), F.struct(F.lit(5).alias("o"), F.col("year").cast("string").alias("c1")),
        F.struct(F.lit(6).alias("o"), F.concat(F.lit("site "), "series_id").alias("c1")),
    )
    head = d.select("series_id", "year").distinct().select("series_id", at.alias("at"), F.explode(heads).alias("h")).select(
        "series_id", (F.col("at") + F.col("h.o")).alias("row"), F.col("h.c1").alias("c1"), *none
    )
    return cells.unionByName(head).select(F.col("series_id").alias("file"), "row", *[f"c{i}" for i in range(1, 13)])


_CELLS = f"""b AS (SELECT DISTINCT series_id, y FROM flow), cal AS (SELECT series_id, y, CAST(unnest(generate_series(make_date(CAST(y AS INTEGER), 1, 1), make_date(CAST(y AS INTEGER), 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM b),
  lines AS (SELECT DISTINCT series_id, y, day(date) AS dd FROM flow),
  c1 AS (SELECT cal.series_id, cal.y, cal.date, CASE WHEN f.value IS NULL THEN '' WHEN f.value = 77 THEN '.' WHEN f.value = 88 THEN '0' WHEN f.value = 500 AND month(cal.date) = 7 THEN '1.2.3' ELSE CAST(CAST(f.value AS BIGINT) AS VARCHAR) || '.5' END AS t
    FROM cal JOIN lines l ON l.series_id = cal.series_id AND l.y = cal.y AND l.dd = day(cal.date) LEFT JOIN flow f ON f.series_id = cal.series_id AND f.date = cal.date),
  c2 AS (SELECT *, TRY_CAST(lag(t) OVER w AS DOUBLE) AS p, TRY_CAST(lead(t) OVER w AS DOUBLE) AS n FROM c1 WINDOW w AS (PARTITION BY series_id, y, month(date) ORDER BY date)),
  c3 AS (SELECT *, CASE WHEN t = '.' THEN (coalesce(p, n) + coalesce(n, p)) / 2 WHEN t = '' THEN -9999 ELSE TRY_CAST(t AS DOUBLE) END AS v FROM c2),
  c4 AS (SELECT *, count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY series_id, y) AS bad FROM c3)"""


@query("ing_blocks_to_daily", "ING-01 ING-02 ING-03 ING-04 ING-05 ING-06 ING-07 ING-08", f"""WITH {T.FLOW_SQL}, {_CELLS}
  SELECT series_id AS file, series_id, 'site ' || series_id AS label, CAST(y AS INTEGER) AS year, date, nullif(v, -9999) AS value FROM c4 WHERE bad = 0""", "value", "date")
def ing_blocks_to_daily(spark, sf):
    blocks = IN.split_blocks(sheet_rows(spark, sf), stride=47, body=9, year=5, site=4, label=6)
    return IN.daily_from_blocks(blocks).select("file", "series_id", "label", "year", "date", "value")


# ---- merging ----


def fragments(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("series_id"), F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("file")
    ).agg(F.sum("l_quantity").alias("value"))


FRAG = """fr AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, l_linenumber AS file, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3),
  sp AS (SELECT series_id, min(date) AS a, max(date) AS b FROM fr GROUP BY 1), cal AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
  mg AS (SELECT cal.series_id, cal.date, m.value FROM cal LEFT JOIN (SELECT series_id, date, arg_min(value, file) AS value FROM fr GROUP BY 1, 2) m ON m.series_id = cal.series_id AND m.date = cal.date)"""


@query("ing_merge_fragments", "ING-09 ING-10 SRC-06 SRC-08", f"WITH {FRAG} SELECT * FROM mg", "value", "date")
def ing_merge_fragments(spark, sf):
    return IN.merge_fragments(fragments(spark, sf))


@query("ing_first_datum", "ING-09 SRC-13", """SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_tax AS datum FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_tax, l_extendedprice) AS r FROM lineitem) WHERE r = 1""", "datum")
def ing_first_datum(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return IN.first_by(li, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_tax", "l_extendedprice"]).select(
        F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_tax").alias("datum"))


def dense(spark, sf):
    return IN.merge_fragments(T.forcing(spark, sf).select("series_id", "date", F.col("gappy").alias("value"), F.lit(1).alias("file")))


DENSE = T.FORCING_SQL + """, sp AS (SELECT series_id, min(date) AS a, max(date) AS b FROM forcing GROUP BY 1), cal AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
  de AS (SELECT cal.series_id, cal.date, gappy AS value FROM cal LEFT JOIN forcing f ON f.series_id = cal.series_id AND f.date = cal.date)"""
GAPS = """g1 AS (SELECT *, sum(CASE WHEN value IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY date) AS g FROM {src}),
  g2 AS (SELECT *, count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY series_id, g) AS len, max(g) OVER (PARTITION BY series_id) AS mg,
     max(date) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY series_id) AS lastv FROM g1),
  gp AS (SELECT series_id, date, value, CASE WHEN value IS NULL THEN len ELSE 0 END AS gap_length, value IS NULL AND g > 0 AND date < lastv AS gap_inside FROM g2)"""


@query("ing_gap_runs", "ING-11", f"WITH {DENSE}, {GAPS.format(src='de')} SELECT * FROM gp", "value", "date")
def ing_gap_runs(spark, sf):
    return IN.gap_runs(dense(spark, sf))


@query("ing_fill_marks", "ING-11", f"WITH {DENSE}, {GAPS.format(src='de')} SELECT series_id, date, gap_inside AND gap_length <= 6 AS was_filled, value IS NOT NULL OR (gap_inside AND gap_length <= 6) AS has_value FROM gp", "", "date")
def ing_fill_marks(spark, sf):
    f = IN.fill_short_gaps(dense(spark, sf))
    return f.select("series_id", "date", "was_filled", F.col("value").isNotNull().alias("has_value"))


@query("ing_clean_discharge", "ING-12")
def ing_clean_discharge(spark, sf):
    return IN.clean_discharge(dense(spark, sf).withColumn("file", F.lit(1)))


CLEAN_MARKS = "SELECT series_id, date, value AS observed, gap_inside AND gap_length <= {gap} AS was_filled FROM gp".format


def clean_marks(cleaned):
    """Which days were filled, and the values of the others; filled values come from a spline."""
    return cleaned.select("series_id", "date", F.when(~F.col("was_filled"), F.col("value")).alias("observed"), "was_filled")


@query("ing_clean_discharge_marks", "ING-12", f"""WITH {DENSE}, cd AS (SELECT series_id, date, CASE WHEN value >= 15 THEN value - 15 END AS value FROM de),
  {GAPS.format(src='cd')} {CLEAN_MARKS(gap=6)}""", "observed", "date")
def ing_clean_discharge_marks(spark, sf):
    """Two files per day of which the first counts, and values below zero."""
    d = dense(spark, sf)
    first = d.select("series_id", "date", (F.col("value") - 15).alias("value"), F.lit(1).alias("file"))
    return clean_marks(IN.clean_discharge(first.union(d.select("series_id", "date", (F.col("value") + 7), F.lit(2)))))


@query("ing_replace_zeros", "ING-13", f"""WITH {T.SUPPLIER_SQL}, z AS (SELECT series_id, date, CASE WHEN value < 10 THEN 0 ELSE value END AS value FROM sup), m AS (SELECT series_id, month(date) AS m, day(date) AS d, median(value) AS md FROM z WHERE value <> 0 GROUP BY 1, 2, 3)
  SELECT z.series_id, date, CASE WHEN value = 0 THEN md ELSE value END AS value FROM z LEFT JOIN m ON m.series_id = z.series_id AND m = month(date) AND d = day(date)""", "value", "date")
def ing_replace_zeros(spark, sf):
    d = T.supplier_flow(spark, sf).select("series_id", "date", F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")).alias("value"))
    return IN.replace_zeros(d)


@query("ing_clean_level", "ING-14")
def ing_clean_level(spark, sf):
    d = dense(spark, sf).withColumn("file", F.lit(1)).withColumn("value", F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")))
    return IN.clean_level(d, reservoir=True)


@query("ing_clean_level_marks", "ING-14", f"""WITH {DENSE}, z AS (SELECT series_id, date, CASE WHEN value < 10 THEN 0 ELSE value END AS value FROM de), md AS (SELECT series_id, month(date) AS m, day(date) AS d, median(value) AS md FROM z WHERE value <> 0 GROUP BY 1, 2, 3),
  rz AS (SELECT z.series_id, z.date, CASE WHEN value = 0 THEN md ELSE value END AS value FROM z LEFT JOIN md ON md.series_id = z.series_id AND m = month(z.date) AND d = day(z.date)), {GAPS.format(src='rz')} {CLEAN_MARKS(gap=15)}""", "observed", "date")
def ing_clean_level_marks(spark, sf):
    return clean_marks(ing_clean_level(spark, sf))


@query("ing_coalesce_datums", "ING-15 ATT-03", """WITH a AS (SELECT s_nationkey AS k, min(s_acctbal) AS h FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), b AS (SELECT c_nationkey AS k, min(c_acctbal) AS h FROM customer GROUP BY 1)
  SELECT CAST(k AS VARCHAR) AS series_id, coalesce(a.h, b.h) AS datum FROM a FULL JOIN b USING (k)""", "datum")
def ing_coalesce_datums(spark, sf):
    a = T.table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").cast("string").alias("series_id")).agg(F.min("s_acctbal").alias("datum"))
    b = T.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("series_id")).agg(F.min("c_acctbal").alias("datum"))
    return IN.coalesce_tables(a, b, ["series_id"], ["datum"])


@query("ing_build_compound", "ING-16 SRC-05", """WITH q AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
  h AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS h FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2), s AS (SELECT CAST(s_suppkey AS VARCHAR) AS series_id, s_acctbal AS area, s_nationkey AS datum FROM supplier)
  SELECT series_id, date, q AS q_cms, h AS lvl_cm, CASE WHEN area > 0 THEN q * 86400 / (area * 1e3) END AS q_mm_day, datum + h / 100.0 AS lvl_abs FROM q FULL JOIN h USING (series_id, date) LEFT JOIN s USING (series_id)""", "q_cms lvl_cm q_mm_day lvl_abs", "date")
def ing_build_compound(spark, sf):
    li = T.table(spark, sf, "lineitem")
    side = lambda cond, n: T.daily_sum(li.where(cond), F.col("l_suppkey"), F.col("l_shipdate"), **{n: F.sum("l_quantity")})
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"), F.col("s_acctbal").alias("area_km2"), F.col("s_nationkey").cast("double").alias("datum"))
    return IN.build_compound(side("l_returnflag <> 'N'", "q_cms"), side("l_returnflag <> 'A'", "lvl_cm"), s)


# ---- provenance ----


def raw_and_shipped(spark, sf):
    f = T.forcing(spark, sf)
    raw = f.select("series_id", "date", F.when(F.col("value") < 30, 0.0).otherwise(F.col("gappy")).alias("value"))
    return raw, f.select("series_id", "date", "value")


MASK = T.FORCING_SQL + """, mk AS (SELECT series_id, date, value AS s, CASE WHEN value < 30 THEN 0.0 ELSE gappy END AS r FROM forcing)"""


@query("ing_fill_mask", "ING-17", f"WITH {MASK} SELECT series_id, date, CAST(CASE WHEN r IS NULL AND s IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS fill_mask FROM mk", "", "date")
def ing_fill_mask(spark, sf):
    return IN.fill_mask(*raw_and_shipped(spark, sf)).withColumn("fill_mask", F.col("fill_mask").cast("int"))


@query("ing_level_mask", "ING-18", f"WITH {MASK} SELECT series_id, date, CAST(CASE WHEN r = 0 THEN 2 WHEN r IS NULL AND s IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS fill_mask FROM mk", "", "date")
def ing_level_mask(spark, sf):
    return IN.fill_mask(*raw_and_shipped(spark, sf), zeros=True).withColumn("fill_mask", F.col("fill_mask").cast("int"))


def edge_input(spark, sf):
    """Dense supplier calendar: a day is present when shipped, and filled when the quantity is small."""
    d = IN.merge_fragments(T.supplier_flow(spark, sf).withColumn("file", F.lit(1)))
    v = F.col("value")
    return d.select("series_id", "date", v.isNotNull().alias("present"), F.coalesce(v < 30, F.lit(False)).alias("filled"))


EDGE = T.SUPPLIER_SQL + """, sp AS (SELECT series_id, min(date) AS a, max(date) AS b FROM sup GROUP BY 1), cal AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
  e0 AS (SELECT cal.series_id, cal.date, value IS NOT NULL AS present, coalesce(value < 30, false) AS filled FROM cal LEFT JOIN sup s ON s.series_id = cal.series_id AND s.date = cal.date),
  e1 AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY series_id, filled ORDER BY date) AS INTEGER) AS g FROM e0),
  e2 AS (SELECT series_id, g, min(date) AS a, max(date) AS b FROM e1 WHERE filled GROUP BY 1, 2),
  e3 AS (SELECT e2.*, coalesce(l.present AND NOT l.filled, false) AND coalesce(r.present AND NOT r.filled, false) AS ok FROM e2 LEFT JOIN e0 l ON l.series_id = e2.series_id AND l.date = e2.a - 1 LEFT JOIN e0 r ON r.series_id = e2.series_id AND r.date = e2.b + 1),
  ef AS (SELECT e1.series_id, e1.date, present, filled, filled AND NOT coalesce(ok, false) AS edge FROM e1 LEFT JOIN e3 ON filled AND e3.series_id = e1.series_id AND e3.g = e1.g)"""


@query("ing_edge_fills", "ING-19", f"WITH {EDGE} SELECT * FROM ef", "", "date")
def ing_edge_fills(spark, sf):
    return IN.edge_fills(edge_input(spark, sf))


@query("ing_blank_edges", "ING-20", f"WITH {EDGE} SELECT ef.series_id, ef.date, CASE WHEN NOT edge THEN sup.value END AS value FROM ef JOIN sup ON sup.series_id = ef.series_id AND sup.date = ef.date", "value", "date")
def ing_blank_edges(spark, sf):
    cells = IN.edge_fills(edge_input(spark, sf)).where("edge")
    return IN.blank_cells(T.supplier_flow(spark, sf).select("series_id", "date", "value"), cells)


@query("ing_quality_codes", "ING-21", f"WITH {EDGE} SELECT series_id, date, CAST(CASE WHEN NOT present THEN 3 WHEN filled THEN 1 ELSE 0 END AS INTEGER) AS code FROM ef", "", "date")
def ing_quality_codes(spark, sf):
    return edge_input(spark, sf).select("series_id", "date", IN.quality_codes(F.col("present"), F.col("filled")).cast("int").alias("code"))


def flagged(spark, sf):
    """Values flagged by the tax of their lines: taxed days count as altered."""
    return T.daily_sum(T.table(spark, sf, "lineitem"), F.col("l_suppkey"), F.col("l_shipdate"),
                       value=F.sum("l_quantity") - 60.0, flag=F.when(F.min("l_tax") >= 0.06, 1).when(F.max("l_tax") <= 0.01, 2).otherwise(0))


FLAG = """fg AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) - 60 AS value, CASE WHEN min(l_tax) >= 0.06 THEN 1 WHEN max(l_tax) <= 0.01 THEN 2 ELSE 0 END AS flag FROM lineitem GROUP BY 1, 2),
  fo AS (SELECT *, coalesce(flag > 0 AND (value < min(value) FILTER (WHERE flag = 0) OVER w OR value > max(value) FILTER (WHERE flag = 0) OVER w), false) AS out_of_range FROM fg WINDOW w AS (PARTITION BY series_id))"""


@query("ing_out_of_range", "ING-22", f"WITH {FLAG} SELECT * FROM fo", "value", "date")
def ing_out_of_range(spark, sf):
    return IN.out_of_range(flagged(spark, sf))


@query("ing_reversion_counts", "ING-23", f"""WITH {FLAG} SELECT series_id, count(*) FILTER (WHERE out_of_range) AS n_reverted, count(*) FILTER (WHERE out_of_range AND flag = 1) AS n_from_fill, count(*) FILTER (WHERE out_of_range AND flag = 2) AS n_from_zero,
  count(*) FILTER (WHERE value < 0) AS n_negative, count(*) FILTER (WHERE value < 0 AND NOT out_of_range) AS n_negative_kept FROM fo GROUP BY 1 HAVING count(*) FILTER (WHERE out_of_range) > 0""")
def ing_reversion_counts(spark, sf):
    return IN.reversion_counts(flagged(spark, sf))


@query("ing_specific_anomaly", "ING-24", f"WITH {T.SUPPLIER_SQL} SELECT series_id, CASE WHEN median(value) > 28 THEN 1 ELSE 0 END AS anomaly FROM sup GROUP BY 1")
def ing_specific_anomaly(spark, sf):
    return IN.specific_anomaly(T.supplier_flow(spark, sf), limit=28.0)


@query("ing_climatology_fill", "ING-25", f"""WITH {T.FORCING_SQL}, f AS (SELECT series_id, date, gappy, count(gappy) FILTER (WHERE year(date) BETWEEN 1995 AND 2000) OVER w AS n, avg(gappy) FILTER (WHERE year(date) BETWEEN 1995 AND 2000) OVER w AS m FROM forcing WINDOW w AS (PARTITION BY series_id, dayofyear(date)))
  SELECT series_id, date, gappy IS NULL AND n >= 3 AS gappy_filled, coalesce(gappy, CASE WHEN n >= 3 THEN m END) AS gappy FROM f""", "gappy", "date")
def ing_climatology_fill(spark, sf):
    f = T.forcing(spark, sf).select("series_id", "date", "gappy")
    return IN.climatology_fill(f, ["gappy"], (1995, 2000))


@query("ing_splice", "ING-26", f"WITH {T.FORCING_SQL} SELECT series_id, date, CASE WHEN gappy IS NULL AND year(date) < 2000 THEN value ELSE gappy END AS gappy FROM forcing", "gappy", "date")
def ing_splice(spark, sf):
    f = T.forcing(spark, sf)
    return IN.splice(f.select("series_id", "date", "gappy"), f.select("series_id", "date", F.col("value").alias("gappy")), ["gappy"], 2000)


@query("ing_fill_counts", "ING-27", f"""WITH {T.FORCING_SQL}, f AS (SELECT series_id, gappy IS NULL AND count(gappy) FILTER (WHERE year(date) BETWEEN 1995 AND 2000) OVER w >= 3 AS a, p_b IS NULL AND count(p_b) FILTER (WHERE year(date) BETWEEN 1995 AND 2000) OVER w >= 3 AS b FROM forcing WINDOW w AS (PARTITION BY series_id, dayofyear(date)))
  SELECT series_id, count(*) FILTER (WHERE a) AS n_gappy, count(*) FILTER (WHERE b) AS n_p_b, CASE WHEN count(*) FILTER (WHERE a OR b) > 0 THEN 'day-of-year fill: ' || CAST(count(*) FILTER (WHERE a) + count(*) FILTER (WHERE b) AS VARCHAR) || ' cells' END AS note FROM f GROUP BY 1""")
def ing_fill_counts(spark, sf):
    f = T.forcing(spark, sf).select("series_id", "date", "gappy", "p_b")
    return IN.fill_counts(IN.climatology_fill(f, ["gappy", "p_b"], (1995, 2000)), ["gappy", "p_b"])


def masked_cells(spark, sf):
    c = T.field(spark, sf).groupBy("lat", "lon").agg(F.sum("prcp").alias("s"))
    return c.select("lat", "lon", F.when(F.col("s") > 2200, F.col("s")).alias("v"))


CELL = T.FIELD_SQL + ", mc AS (SELECT lat, lon, CASE WHEN sum(prcp) > 2200 THEN sum(prcp) END AS v FROM field GROUP BY 1, 2)"


@query("ing_nearest_valid_cells", "ING-28", f"""WITH {CELL}, {T.SITES_SQL}, p AS (SELECT series_id, lat, lon, CAST(floor(lat / 0.1 + 0.5) AS BIGINT) AS ky, CAST(floor(lon / 0.1 + 0.5) AS BIGINT) AS px FROM sites),
  c AS (SELECT lat, lon, CAST(floor(lat / 0.1 + 0.5) AS BIGINT) AS ky, CAST(floor(lon / 0.1 + 0.5) AS BIGINT) AS kx FROM mc WHERE v IS NOT NULL),
  h AS (SELECT p.series_id, min(px - kx) AS k FROM p JOIN c ON c.ky = p.ky AND px - kx BETWEEN 0 AND 20 GROUP BY 1)
  SELECT p.series_id, coalesce(c.lat, p.lat) AS lat, coalesce(c.lon, p.lon) AS lon, CAST(h.k AS DOUBLE) AS shifted FROM p LEFT JOIN h USING (series_id) LEFT JOIN c ON c.ky = p.ky AND c.kx = px - h.k""", "lat lon shifted")
def ing_nearest_valid_cells(spark, sf):
    out = IN_grid().nearest_valid_cells(T.sites(spark, sf), masked_cells(spark, sf), 0.1, max_west=2.0)
    return out.withColumn("shifted", F.col("shifted").cast("double"))


def IN_grid():
    from ..operators import grid

    return grid


@query("ing_point_series", "ING-29", f"""WITH {T.FIELD_SQL}, {T.SITES_SQL} SELECT series_id, date, avg(prcp) AS prcp FROM sites s JOIN field f ON floor(s.lat / 0.1 + 0.5) = floor(f.lat / 0.1 + 0.5) AND floor(s.lon / 0.1 + 0.5) = floor(f.lon / 0.1 + 0.5) GROUP BY 1, 2""", "prcp", "date")
def ing_point_series(spark, sf):
    return IN_grid().point_series(T.sites(spark, sf), T.field(spark, sf), ["prcp"])


@query("ing_null_summary", "ING-30", f"WITH {T.FORCING_SQL} SELECT series_id, {', '.join(f'1 - count({c}) * 1.0 / count(*) AS {c}_null_frac, min({c}) AS {c}_min, max({c}) AS {c}_max' for c in ('gappy', 't'))} FROM forcing GROUP BY 1", "gappy_null_frac gappy_min gappy_max t_null_frac t_min t_max")
def ing_null_summary(spark, sf):
    return IN.null_summary(T.forcing(spark, sf), ["gappy", "t"])


@query("ing_hourly_to_daily", "ING-31", """SELECT event_type AS series_id, CAST(ts AS DATE) AS date, avg(value - 273.15) AS t_mean, min(value - 273.15) AS t_min, max(value - 273.15) AS t_max FROM events GROUP BY 1, 2""", "t_mean t_min t_max", "date")
def ing_hourly_to_daily(spark, sf):
    e = T.table(spark, sf, "events")
    return IN.hourly_to_daily(e.select(F.col("event_type").alias("series_id"), "ts", "value"))


def steps(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"), (F.hour("ts") + 1).alias("step")).agg(F.sum(F.round(F.col("value") * 100)).alias("value"))


STEP = "st AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, hour(ts) + 1 AS step, sum(round(value * 100)) AS value FROM events GROUP BY 1, 2, 3)"


@query("ing_deaccumulate", "ING-32", f"WITH {STEP} SELECT series_id, date, coalesce(max(value) FILTER (WHERE step = 24), arg_max(value, step)) AS value FROM st GROUP BY 1, 2", "value", "date")
def ing_deaccumulate(spark, sf):
    return IN.deaccumulate(steps(spark, sf))


@query("ing_heal_days", "ING-33", f"WITH {FRAG} SELECT series_id, date, max(value) AS value FROM fr GROUP BY 1, 2", "value", "date")
def ing_heal_days(spark, sf):
    return IN.heal_days(fragments(spark, sf))


@query("ing_closed_months", "ING-34", f"""WITH {DENSE}, dy AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, date, count(value) AS n FROM de GROUP BY 1, 2), m AS (SELECT month, count(*) AS n_days, min(n) > 0 AS complete FROM dy GROUP BY 1)
  SELECT month, n_days, lead(month) OVER (ORDER BY month) IS NOT NULL AS has_next, complete, complete AND lead(month) OVER (ORDER BY month) IS NOT NULL AS closed FROM m""", "", "month")
def ing_closed_months(spark, sf):
    return IN.closed_months(dense(spark, sf)).withColumn("has_next", F.coalesce("has_next", F.lit(False)))


@query("ing_covered_months", "ING-35", f"""WITH {T.SUPPLIER_SQL}, c AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT series_id) AS n FROM sup WHERE value >= 10 GROUP BY 1) SELECT month FROM c WHERE n = (SELECT count(DISTINCT series_id) FROM sup)""", "", "month")
def ing_covered_months(spark, sf):
    d = T.supplier_flow(spark, sf).withColumn("value", F.when(F.col("value") >= 10, F.col("value")))
    return IN.covered_months(d)


@query("ing_in_months", "ING-36", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-05-01' AND o_orderdate < DATE '1998-03-01' GROUP BY 1, 2""")
def ing_in_months(spark, sf):
    m = T.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return IN.in_months(m, (1996, 5), (1998, 2))


@query("ing_renormalise", "ING-37", "SELECT p_partkey, p_size / (p_size / 50.0) AS p_size, p_retailprice / (p_size / 50.0) AS p_retailprice, p_size / 50.0 AS coverage FROM part", "p_size p_retailprice coverage")
def ing_renormalise(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") / 50.0).alias("coverage"))
    return IN.renormalise(p, ["p_size", "p_retailprice"], "coverage")


@query("ing_coverage_tracking", "ING-37", "SELECT corr(p_size + p_retailprice, p_size / 50.0) AS r, abs(corr(p_size + p_retailprice, p_size / 50.0)) < 0.3 AS already_done FROM part", "r")
def ing_coverage_tracking(spark, sf):
    p = T.table(spark, sf, "part").withColumn("coverage", F.col("p_size") / 50.0)
    return IN.coverage_tracking(p, ["p_size", "p_retailprice"], "coverage")


@query("ing_classify_coverage", "ING-38", f"""WITH {T.FORCING_SQL}, x AS (SELECT series_id, count(gappy) > 0 AS has_data, count(gappy) < count(*) AS hn, min(date) FILTER (WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-01-05') AS a, max(date) FILTER (WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-01-05') AS b,
   count(*) FILTER (WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-01-05' AND gappy IS NULL) AS h FROM forcing GROUP BY 1)
  SELECT series_id, CASE WHEN NOT has_data THEN 'empty' WHEN a = DATE '1996-01-01' AND b >= DATE '1996-01-05' AND h = 0 THEN 'full' ELSE 'partial' END AS status, has_data AND hn AS has_nulls, has_data FROM x""")
def ing_classify_coverage(spark, sf):
    return IN.classify_coverage(T.forcing(spark, sf).withColumn("value", F.col("gappy")), "1996-01-01", "1996-01-05")


# ---- scope and filters ----


@query("flt_scope_summary", "FLT-01 FLT-03", "SELECT count(*) AS n_total, count(*) FILTER (WHERE length(CAST(o_orderkey AS VARCHAR)) < 4) AS n_included, count(*) FILTER (WHERE length(CAST(o_orderkey AS VARCHAR)) >= 4) AS n_excluded FROM orders")
def flt_scope_summary(spark, sf):
    return FL.scope_summary(T.table(spark, sf, "orders"), "o_orderkey", 4)


@query("flt_in_scope", "FLT-02", "SELECT o_orderkey, o_totalprice FROM orders WHERE length(CAST(o_orderkey AS VARCHAR)) < 4", "o_totalprice")
def flt_in_scope(spark, sf):
    return FL.in_scope(T.table(spark, sf, "orders"), "o_orderkey", 4).select("o_orderkey", "o_totalprice")


@query("flt_size_class", "FLT-04", """SELECT s_suppkey, CASE WHEN s_acctbal * 30 < 100 THEN 'a) < 100 $km^2$' WHEN s_acctbal * 30 <= 2000 THEN 'b) 100 $km^2$ - 2 000 $km^2$' WHEN s_acctbal * 30 <= 10000 THEN 'c) 2 000 $km^2$ - 10 000 $km^2$'
  WHEN s_acctbal * 30 <= 50000 THEN 'd) 10 000 $km^2$ - 50 000 $km^2$' WHEN s_acctbal * 30 <= 200000 THEN 'e) 50 000 $km^2$ - 200 000 $km^2$' ELSE 'f) > 200 000 $km^2$' END AS size_class FROM supplier""")
def flt_size_class(spark, sf):
    return T.table(spark, sf, "supplier").select("s_suppkey", FL.size_class(F.col("s_acctbal") * 30).alias("size_class"))


def _grades(spark, sf):
    from ..operators import grading

    return grading.series_grades(supplier_years(spark, sf))


OV = f"{SUPY}, {overall_cte('yr', 'ov')}"


@query("flt_ids_by_grade", "FLT-05 SRC-04", f"WITH {OV} SELECT DISTINCT series_id FROM ov WHERE overall IN ('A', 'B', 'C') ORDER BY 1")
def flt_ids_by_grade(spark, sf):
    return FL.ids_by_grade(_grades(spark, sf), FL.USABLE)


@query("flt_at_least_grade", "FLT-06", f"WITH {SUPY} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, grade FROM yr WHERE grade IN ('A', 'B', 'C')")
def flt_at_least_grade(spark, sf):
    return FL.at_least_grade(supplier_years(spark, sf), "C").select("series_id", "hydro_year", "grade")


@query("flt_drop_low_years", "FLT-07", f"WITH {SUPY} SELECT o.series_id, date, CASE WHEN grade NOT IN ('D', 'F') THEN value END AS value FROM o JOIN yr USING (series_id, hy)", "value", "date")
def flt_drop_low_years(spark, sf):
    return FL.drop_low_years(T.supplier_flow(spark, sf).drop("p"), supplier_years(spark, sf)).select("series_id", "date", "value")


@query("flt_keep_grades", "SRC-05", f"WITH {SUPY} SELECT o.series_id, date, CASE WHEN grade IN ('A', 'B') THEN value END AS value FROM o JOIN yr USING (series_id, hy)", "value", "date")
def flt_keep_grades(spark, sf):
    d = T.supplier_flow(spark, sf).withColumn("hydro_year", C.hydro_year(F.col("date")))
    g = d.join(supplier_years(spark, sf).select("series_id", "hydro_year", "grade"), ["series_id", "hydro_year"])
    return FL.keep_grades(g, ("A", "B")).select("series_id", "date", "value")


@query("flt_grade_statistics", "FLT-08", f"WITH {OV} SELECT overall AS grade, count(*) AS n_series, count(*) * 100.0 / (SELECT count(*) FROM ov) AS pct_total FROM ov GROUP BY 1", "pct_total")
def flt_grade_statistics(spark, sf):
    return FL.grade_statistics(_grades(spark, sf))


@query("flt_first_year_grades", "FLT-09", f"WITH {SUPY} SELECT series_id, CAST(hy AS INTEGER) AS hydro_year, grade FROM yr")
def flt_first_year_grades(spark, sf):
    from ..operators import grading

    d = grading.attach_grades(T.supplier_flow(spark, sf), supplier_years(spark, sf), min_values=1).drop("hydro_year")
    return grading.first_year_grades(d)


@query("flt_attribute_columns", "FLT-10", "SELECT s_suppkey, s_acctbal * 2 AS pre_mm_uyr, s_acctbal * 3 AS snw_pc_syr FROM supplier", "pre_mm_uyr snw_pc_syr")
def flt_attribute_columns(spark, sf):
    s = T.table(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_acctbal") * 2).alias("pre_mm_uyr"), F.col("s_acctbal").alias("snw_pc_uyr"),
        (F.col("s_acctbal") * 3).alias("snw_pc_syr"), F.col("s_acctbal").alias("ele_mt_max"))
    return FL.pick_attributes(s, ["s_suppkey"])


@query("flt_analysis_subset", "FLT-11", f"""WITH {OV} SELECT series_id, overall AS overall_grade, least(100.0, greatest(0.0, s_acctbal / 50)) AS permafrost FROM ov JOIN supplier ON series_id = CAST(s_suppkey AS VARCHAR)
  WHERE NOT s_acctbal > 9000 AND s_nationkey < 12 AND overall IN ('A', 'B')""", "permafrost")
def flt_analysis_subset(spark, sf):
    s = T.table(spark, sf, "supplier").withColumn("series_id", F.col("s_suppkey").cast("string"))
    sig = s.select("series_id", (F.col("s_acctbal") > 9000).alias("is_anomalous"))
    att = s.select("series_id", (F.col("s_nationkey") >= 12).cast("int").alias("regulation"), (F.col("s_acctbal") / 50).alias("permafrost"))
    return FL.analysis_subset(sig, att, _grades(spark, sf)).select("series_id", "overall_grade", "permafrost")


# ---- spatial ----

AREA = f"{T.DIAMONDS_SQL}, {area_sql('vert', 'poly_id', 'pa')}"


@query("spa_polygon_areas", "SPA-01", f"WITH {AREA} SELECT poly_id, 1 AS part, area_km2 FROM pa", "area_km2")
def spa_polygon_areas(spark, sf):
    return SP.polygon_areas(T.diamonds(spark, sf))


@query("spa_largest_parts", "SPA-02", f"""WITH {T.DIAMONDS_SQL}, {area_sql('vert', 'poly_id', 'pa')}, n AS (SELECT CAST(s_nationkey AS VARCHAR) AS nk, s_suppkey, area_km2 FROM pa JOIN supplier ON poly_id = CAST(s_suppkey AS VARCHAR))
  SELECT nk AS poly_id, s_suppkey AS part, area_km2 FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY area_km2 DESC, s_suppkey) AS r FROM n) WHERE r = 1""", "area_km2")
def spa_largest_parts(spark, sf):
    n = T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("site"), "s_suppkey", F.col("s_nationkey").cast("string").alias("nk"))
    v = T.diamonds(spark, sf).withColumnRenamed("poly_id", "site").drop("part").join(n, "site")
    v = v.select(F.col("nk").alias("poly_id"), F.col("s_suppkey").alias("part"), "seq", "lon", "lat")
    return SP.largest_parts(SP.polygon_areas(v))


@query("spa_bounding_boxes", "SPA-03 SPA-14", f"WITH {T.DIAMONDS_SQL} SELECT poly_id, min(lon) AS x1, min(lat) AS y1, max(lon) AS x2, max(lat) AS y2, (min(lon) + max(lon)) / 2 AS lon_c, (min(lat) + max(lat)) / 2 AS lat_c FROM vert GROUP BY 1", "x1 y1 x2 y2 lon_c lat_c")
def spa_bounding_boxes(spark, sf):
    return SP.bounding_boxes(T.diamonds(spark, sf))


def area_sites(spark, sf):
    return T.sites(spark, sf).join(SP.polygon_areas(T.diamonds(spark, sf)).select(F.col("poly_id").alias("series_id"), "area_km2"), "series_id")


PAIRS = f"""{AREA}, pr AS (SELECT c.series_id AS child, p.series_id AS parent, ca.area_km2 AS child_area, pp.area_km2 AS parent_area FROM sites c JOIN sites p ON c.series_id <> p.series_id AND abs(c.lon - p.lon) + abs(c.lat - p.lat) < p.r
   JOIN pa ca ON ca.poly_id = c.series_id JOIN pa pp ON pp.poly_id = p.series_id WHERE pp.area_km2 > ca.area_km2)"""


@query("spa_nested_pairs", "SPA-04", f"""WITH {AREA} SELECT c.series_id AS child, p.series_id AS parent, ca.area_km2 AS child_area, pp.area_km2 AS parent_area FROM sites c JOIN sites p ON c.series_id <> p.series_id AND abs(c.lat - p.lat) < p.r
   AND ((abs(c.lon - p.lon) + abs(c.lat - p.lat) < p.r AND NOT abs(c.lon - p.lon) + abs(c.lat - p.lat) < CAST(0.4 AS DOUBLE) * p.r) OR abs(c.lon - p.lon - CAST(1.6 AS DOUBLE) * p.r) + abs(c.lat - p.lat) < CAST(0.3 AS DOUBLE) * p.r)
   JOIN pa ca ON ca.poly_id = c.series_id JOIN pa pp ON pp.poly_id = p.series_id WHERE pp.area_km2 > ca.area_km2""", "child_area parent_area")
def spa_nested_pairs(spark, sf):
    """Catchments of two parts, one of them with a hole."""
    return SP.nested_pairs(area_sites(spark, sf), T.holed_diamonds(spark, sf))


DEPTH = f"WITH RECURSIVE {PAIRS}, lv AS (SELECT series_id, 0 AS d FROM sites UNION SELECT pr.child, lv.d + 1 FROM lv JOIN pr ON pr.parent = lv.series_id), dp AS (SELECT series_id, max(d) AS depth FROM lv GROUP BY 1)"


@query("spa_nesting_depth", "SPA-04 SPA-05", f"{DEPTH} SELECT * FROM dp")
def spa_nesting_depth(spark, sf):
    s = area_sites(spark, sf)
    return SP.nesting_depth(s, SP.nested_pairs(s, T.diamonds(spark, sf)))


@query("spa_nesting_summary", "SPA-04 SPA-05", f"{DEPTH} SELECT (SELECT count(*) FROM sites) AS n_sites, (SELECT count(DISTINCT child) FROM pr) AS n_nested, (SELECT count(*) FROM pr) AS n_pairs, max(depth) AS max_depth, (SELECT count(DISTINCT child) FROM pr) * 100.0 / (SELECT count(*) FROM sites) AS pct_nested FROM dp", "pct_nested")
def spa_nesting_summary(spark, sf):
    s = area_sites(spark, sf)
    p = SP.nested_pairs(s, T.diamonds(spark, sf))
    return SP.nesting_summary(s, p, SP.nesting_depth(s, p))


@query("spa_immediate_parents", "SPA-04", f"WITH {PAIRS} SELECT child, count(*) AS n_parents, arg_min(parent, parent_area) AS parent, min(parent_area) AS parent_area FROM pr GROUP BY 1", "parent_area")
def spa_immediate_parents(spark, sf):
    return SP.immediate_parents(SP.nested_pairs(area_sites(spark, sf), T.diamonds(spark, sf)))


@query("spa_nesting_chains", "SPA-04", f"WITH RECURSIVE {PAIRS}, up AS (SELECT child, arg_min(parent, parent_area) AS parent FROM pr GROUP BY 1), ch AS (SELECT series_id AS \"start\", 0 AS step, series_id FROM sites UNION ALL SELECT ch.start, step + 1, up.parent FROM ch JOIN up ON up.child = ch.series_id) SELECT * FROM ch")
def spa_nesting_chains(spark, sf):
    s = area_sites(spark, sf)
    return SP.nesting_chain(SP.nested_pairs(s, T.diamonds(spark, sf)), s.select("series_id"))


BAL = f"""{T.SUPPLIER_SQL}, {PAIRS}, nb AS (SELECT child, parent, count(*) AS n_common, max(parent_area) / max(child_area) AS area_ratio, sum(b.value) / sum(a.value) AS v_ratio FROM pr JOIN sup a ON a.series_id = child JOIN sup b ON b.series_id = parent AND b.date = a.date GROUP BY 1, 2 HAVING count(*) >= 50)"""


@query("spa_nested_balance", "SPA-06", f"WITH {BAL} SELECT * FROM nb", "area_ratio v_ratio")
def spa_nested_balance(spark, sf):
    p = SP.nested_pairs(area_sites(spark, sf), T.diamonds(spark, sf))
    return SP.nested_balance(p, T.supplier_flow(spark, sf), min_days=50)


@query("spa_ratio_strata", "SPA-07", f"""WITH {BAL}, b AS (SELECT CASE WHEN area_ratio > 1 AND area_ratio <= 2 THEN '1-2' WHEN area_ratio > 2 AND area_ratio <= 5 THEN '2-5' WHEN area_ratio > 5 THEN '>5' END AS band, v_ratio <= 1 AS bad FROM nb)
  SELECT coalesce(band, 'All') AS band, count(*) AS n_pairs, count(*) * 100.0 / (SELECT count(*) FROM b WHERE band IS NOT NULL) AS share_pct, count(*) FILTER (WHERE bad) AS n_violations, count(*) FILTER (WHERE bad) * 100.0 / count(*) AS fail_pct FROM b WHERE band IS NOT NULL GROUP BY ROLLUP (band)""", "share_pct fail_pct")
def spa_ratio_strata(spark, sf):
    p = SP.nested_pairs(area_sites(spark, sf), T.diamonds(spark, sf))
    return SP.ratio_strata(SP.nested_balance(p, T.supplier_flow(spark, sf), min_days=50), (1.0, 2.0, 5.0, float("inf")), ("1-2", "2-5", ">5"))


def river_points(spark, sf):
    """Customers as outlet points and parts as river features, on tiles half a degree wide."""
    c, p = T.table(spark, sf, "customer"), T.table(spark, sf, "part")
    k = F.col("c_custkey")
    pts = c.select(k.cast("string").alias("series_id"), (30.0 + 0.0013 * k).alias("lon"), (50.0 + 0.01 * (k % 13)).alias("lat"))
    pts = pts.withColumn("tile", F.floor(F.col("lon") / 0.5))
    q = F.col("p_partkey")
    size = F.col("p_size")
    klass = F.when(size <= 20, "small_rivers").when(size <= 35, "medium_rivers").when(size <= 45, "rivers").when(size <= 48, "big_rivers").otherwise("large_rivers")
    f = p.select(q.alias("feature_id"), (30.0 + 0.001 * q).alias("lon"), (50.0 + 0.01 * (q % 17)).alias("lat"), klass.alias("river_class"))
    return pts, f.withColumn("tile", F.floor(F.col("lon") / 0.5))


HAV = "2 * {r} * atan2(sqrt(h), sqrt(1 - h))".format
HH = "sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) ** 2".format


@query("spa_nearest_feature", "SPA-08", f"""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS series_id, CAST(30.0 AS DOUBLE) + CAST(0.0013 AS DOUBLE) * c_custkey AS lon, CAST(50.0 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (c_custkey % 13) AS lat FROM customer),
  f AS (SELECT p_partkey AS feature_id, CAST(30.0 AS DOUBLE) + CAST(0.001 AS DOUBLE) * p_partkey AS fx, CAST(50.0 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (p_partkey % 17) AS fy, CASE WHEN p_size <= 20 THEN 80 WHEN p_size <= 35 THEN 800 WHEN p_size <= 45 THEN 8000 WHEN p_size <= 48 THEN 80000 ELSE 800000 END AS approx_area FROM part),
  j AS (SELECT series_id, feature_id, approx_area, {HH(a='lat', b='fy', c='lon', d='fx')} AS h FROM p JOIN f ON floor(p.lon / 0.5) = floor(f.fx / 0.5)),
  k AS (SELECT *, {HAV(r='CAST(6371.0088 AS DOUBLE)')} AS dist FROM j)
  SELECT series_id, round(dist, 4) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dist, approx_area, feature_id) AS r FROM k) WHERE r = 1""", "distance_km")
def spa_nearest_feature(spark, sf):
    return SP.nearest_feature(*river_points(spark, sf)).select("series_id", F.round("distance_km", 4).alias("distance_km"))


def match_input(spark, sf):
    k = F.col("c_custkey")
    st = T.table(spark, sf, "customer").select(
        k.alias("id"), (30.0 + 0.0013 * (k % 30000)).alias("lon"), (50.0 + 0.5 * F.floor(k / 30000) + 0.013 * (k % 11)).alias("lat"), F.col("c_acctbal").alias("area_km2"))
    s = T.sites(spark, sf).select(F.col("series_id").cast("long").alias("id"), "lon", "lat", (F.col("r") * 40000).alias("area_km2"))
    return st, s


@query("spa_match_sites", "SPA-09", f"""WITH {T.SITES_SQL}, st AS (SELECT c_custkey AS id, CAST(30.0 AS DOUBLE) + CAST(0.0013 AS DOUBLE) * (c_custkey % 30000) AS lon, CAST(50.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (c_custkey // 30000) + CAST(0.013 AS DOUBLE) * (c_custkey % 11) AS lat, c_acctbal AS area FROM customer),
  j AS (SELECT st.id AS station_id, CAST(s.series_id AS BIGINT) AS site_id, st.area, s.r * 40000 AS sa, {HH(a='st.lat', b='s.lat', c='st.lon', d='s.lon')} AS h, row_number() OVER (PARTITION BY st.id ORDER BY (st.lon - s.lon) ** 2 + (st.lat - s.lat) ** 2, CAST(s.series_id AS BIGINT)) AS r FROM st CROSS JOIN sites s)
  SELECT station_id, site_id, {HAV(r='CAST(6371.0 AS DOUBLE)')} AS distance_km, CASE WHEN area > 0 AND sa > 0 THEN sa / area END AS area_ratio FROM j WHERE r = 1 AND {HAV(r='CAST(6371.0 AS DOUBLE)')} <= 25 AND (NOT (area > 0 AND sa > 0) OR sa / area BETWEEN 0.5 AND 2)""", "distance_km area_ratio")
def spa_match_sites(spark, sf):
    return SP.match_sites(*match_input(spark, sf))


@query("spa_site_coordinates", "SPA-10", f"WITH {T.SITES_SQL} SELECT series_id, CAST(series_id AS BIGINT) AS pos, lon, lat FROM sites", "lon lat")
def spa_site_coordinates(spark, sf):
    s = T.sites(spark, sf)
    wanted = s.select("series_id", F.col("series_id").cast("long").alias("pos"))
    return SP.site_coordinates(s, wanted)


def hex_points(spark, sf):
    k = F.col("c_custkey")
    return T.table(spark, sf, "customer").select(
        k.alias("id"), (k * 137.0 - 40000.0).alias("x"), (F.col("c_acctbal") * 31.0).alias("y"), F.col("c_acctbal").alias("v"),
        F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"))


HEX = """hx0 AS (SELECT c_custkey AS id, c_custkey * CAST(137.0 AS DOUBLE) - 40000 AS x, c_acctbal * 31 AS y, c_acctbal AS v, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS segment FROM customer),
  hx1 AS (SELECT *, (sqrt(3.0) * x / 3 - y / 3) / 66000 AS cq, 2 * y / (3 * 66000.0) AS cr FROM hx0), hx2 AS (SELECT *, -cq - cr AS cs, floor(cq + 0.5) AS a, floor(cr + 0.5) AS b, floor(-cq - cr + 0.5) AS c FROM hx1),
  hx3 AS (SELECT *, a + b + c AS e, abs(a - cq) AS eq, abs(b - cr) AS er, abs(c - cs) AS es FROM hx2),
  hx AS (SELECT id, x, y, v, segment, CAST(a - CASE WHEN eq >= er AND eq >= es THEN e ELSE 0 END AS BIGINT) AS q, CAST(b - CASE WHEN NOT (eq >= er AND eq >= es) AND er >= es THEN e ELSE 0 END AS BIGINT) AS r FROM hx3)"""


@query("spa_hex_cells", "SPA-11", f"WITH {HEX} SELECT *, CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS hex_id FROM hx", "x y v")
def spa_hex_cells(spark, sf):
    return SP.hex_cells(hex_points(spark, sf))


@query("spa_hex_median", "SPA-12", f"WITH {HEX} SELECT CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS hex_id, q, r, count(*) AS n_total, count(v) AS n_valid, count(*) - count(v) AS n_missing, median(v) AS value FROM hx GROUP BY 1, 2, 3", "value")
def spa_hex_median(spark, sf):
    return SP.aggregate_hex(hex_points(spark, sf), "v")


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("spa_hex_mode", "SPA-12 SPA-13", f"""WITH {HEX}, n AS (SELECT q, r, segment, count(*) AS n FROM hx GROUP BY 1, 2, 3)
  SELECT CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS hex_id, q, r, CAST(sum(n) AS BIGINT) AS n_total, CAST(coalesce(sum(n) FILTER (WHERE segment IS NOT NULL), 0) AS BIGINT) AS n_valid, CAST(coalesce(sum(n) FILTER (WHERE segment IS NULL), 0) AS BIGINT) AS n_missing,
   coalesce((SELECT segment FROM n m WHERE m.q = n.q AND m.r = n.r AND segment IS NOT NULL ORDER BY m.n DESC, segment LIMIT 1), 'AUTOMOBILE') AS value, count(segment) AS n_categories FROM n GROUP BY q, r""")
def spa_hex_mode(spark, sf):
    return SP.aggregate_hex(hex_points(spark, sf), "segment", categories=_SEG)
