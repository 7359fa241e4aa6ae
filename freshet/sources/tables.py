"""Canonical daily tables derived from the driver tables.

Raw records are summed to one row per (series, day) straight after the scan.  The sum is
combined on the map side, so a series that holds a third of all raw records still sends at
most one row per day and map task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily_sum(df: DataFrame, series: Column, date: Column, **measures: Column) -> DataFrame:
    """Collapse raw records to ``(series_id, date, measures…)``."""
    return df.groupBy(series.cast("string").alias("series_id"), F.to_date(date).alias("date")).agg(
        *[m.alias(n) for n, m in measures.items()]
    )


def forcing(spark: SparkSession, sf: str) -> DataFrame:
    """Flow, three water-input products, temperature and evaporation per return/line status and day."""
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return daily_sum(
        table(spark, sf, "lineitem"),
        F.concat("l_returnflag", "l_linestatus"),
        F.col("l_shipdate"),
        value=F.sum("l_quantity"),
        gappy=F.sum(F.when(disc >= 0.05, F.col("l_quantity"))),
        p_a=F.round(F.sum(price) / 1000.0, 5),
        p_b=F.round(F.sum(F.when(disc >= 0.02, price)) / 1000.0, 5),
        p_c=F.round(F.sum(F.when(tax >= 0.01, price)) / 1000.0, 5),
        t=F.round(F.avg(disc) * 400.0 - 20.0, 6),
        pet=F.round(F.sum(F.when(tax >= 0.04, price)) / 1000.0, 5),
    )


def flow(spark: SparkSession, sf: str) -> DataFrame:
    return forcing(spark, sf).select("series_id", "date", "value")


def supplier_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse series: one per supplier, with natural gaps between ship days."""
    return daily_sum(
        table(spark, sf, "lineitem"), F.col("l_suppkey"), F.col("l_shipdate"),
        value=F.sum("l_quantity"), p=F.round(F.sum("l_extendedprice") / 1000.0, 5),
    )


FORCING_SQL = """forcing AS (
  SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS value,
         sum(CASE WHEN l_discount >= 0.05 THEN l_quantity END) AS gappy,
         round(sum(l_extendedprice) / 1000.0, 5) AS p_a,
         round(sum(CASE WHEN l_discount >= 0.02 THEN l_extendedprice END) / 1000.0, 5) AS p_b,
         round(sum(CASE WHEN l_tax >= 0.01 THEN l_extendedprice END) / 1000.0, 5) AS p_c,
         round(avg(l_discount) * 400.0 - 20.0, 6) AS t,
         round(sum(CASE WHEN l_tax >= 0.04 THEN l_extendedprice END) / 1000.0, 5) AS pet
  FROM lineitem GROUP BY 1, 2)"""

FLOW_SQL = (
    FORCING_SQL
    + """, flow AS (SELECT series_id, date, value, year(date) AS y, month(date) AS m, dayofyear(date) AS doy,
  year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS hy FROM forcing WHERE value IS NOT NULL)"""
)

SUPPLIER_SQL = """sup AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS value, round(sum(l_extendedprice) / 1000.0, 5) AS p
  FROM lineitem GROUP BY 1, 2)"""


# --- spatial demonstration data derived from keys and amounts ------------------------------------------


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers laid out on a map with a spread, rows of 2,000, so density does not grow with the data."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.cast("string").alias("series_id"), (30.0 + 0.02 * (k % 2000)).alias("lon"),
        (50.0 + 0.5 * F.floor(k / 2000) + 0.01 * (k % 7)).alias("lat"), (0.03 + 0.2 * (F.col("s_acctbal") + 1000.0) / 11000.0).alias("r"),
    )


def _corners(df: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    pts = F.array(*[
        F.struct(F.lit(i).alias("seq"), (F.col("lon") + F.col("r") * dx).alias("x"), (F.col("lat") + F.col("r") * dy).alias("y"))
        for i, (dx, dy) in enumerate(corners)
    ])
    return df.select(F.col("series_id").alias("poly_id"), F.lit(1).alias("part"), F.explode(pts).alias("p")).select(
        "poly_id", "part", "p.seq", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")
    )


def diamonds(spark: SparkSession, sf: str) -> DataFrame:
    """Four-cornered catchments around the sites."""
    return _corners(sites(spark, sf), [(-1.0, 0.0), (0.0, -1.0), (1.0, 0.0), (0.0, 1.0)])


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangular catchments, twice as wide as high."""
    return _corners(sites(spark, sf), [(-1.0, -0.5), (1.0, -0.5), (1.0, 0.5), (-1.0, 0.5)])


def _shapes(df: DataFrame, shapes: dict[tuple[int, int], list[tuple[float, float]]]) -> DataFrame:
    """Several parts and rings around each site: ``(part, ring) -> corners`` in units of its spread."""
    pts = F.array(*[
        F.struct(F.lit(part).alias("part"), F.lit(ring).alias("ring"), F.lit(i).alias("seq"), (F.col("lon") + F.col("r") * dx).alias("x"), (F.col("lat") + F.col("r") * dy).alias("y"))
        for (part, ring), corners in shapes.items() for i, (dx, dy) in enumerate(corners)
    ])
    return df.select(F.col("series_id").alias("poly_id"), F.explode(pts).alias("p")).select(
        "poly_id", "p.part", "p.ring", "p.seq", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")
    )


def holed_diamonds(spark: SparkSession, sf: str) -> DataFrame:
    """Diamonds with a hole around the site and a small second part to the east."""
    ring = lambda r, x=0.0: [(x - r, 0.0), (x, -r), (x + r, 0.0), (x, r)]
    return _shapes(sites(spark, sf), {(1, 0): ring(1.0), (1, 1): ring(0.4), (2, 0): ring(0.3, 1.6)})


def holed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles with a hole and a small second part to the east."""
    ring = lambda x1, x2, h: [(x1, -h), (x2, -h), (x2, h), (x1, h)]
    return _shapes(sites(spark, sf), {(1, 0): ring(-1.0, 1.0, 0.5), (1, 1): ring(-0.5, 0.5, 0.25), (2, 0): ring(1.5, 2.5, 0.25)})


def _cell_columns() -> tuple[Column, Column]:
    k = F.col("l_suppkey")
    return 50.0 + 0.5 * F.floor(k / 2000) + 0.1 * (F.col("l_linenumber") - 4), 30.0 + 0.1 * F.floor((k % 2000) / 5)


def field_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct grid cells, from two columns of the raw table instead of the daily field."""
    lat, lon = _cell_columns()
    return table(spark, sf, "lineitem").select(lat.alias("lat"), lon.alias("lon")).distinct()


def field(spark: SparkSession, sf: str) -> DataFrame:
    """Gridded daily field at 0.1 degrees: quantity as water, discount as temperature."""
    lat, lon = _cell_columns()
    return table(spark, sf, "lineitem").groupBy(
        lat.alias("lat"), lon.alias("lon"), F.to_date("l_shipdate").alias("date")
    ).agg(F.sum("l_quantity").alias("prcp"), F.round(F.avg("l_discount") * 400.0 - 20.0, 6).alias("t"))


SITES_SQL = """sites AS (SELECT CAST(s_suppkey AS VARCHAR) AS series_id, 30.0 + CAST(0.02 AS DOUBLE) * (s_suppkey % 2000) AS lon,
   CAST(50.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (s_suppkey // 2000) + CAST(0.01 AS DOUBLE) * (s_suppkey % 7) AS lat,
   CAST(0.03 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (s_acctbal + 1000.0) / 11000.0 AS r FROM supplier)"""
DIAMONDS_SQL = SITES_SQL + """, vert AS (SELECT series_id AS poly_id, seq, lon + r * dx AS lon, lat + r * dy AS lat FROM sites
   CROSS JOIN (VALUES (0, -1.0, 0.0), (1, 0.0, -1.0), (2, 1.0, 0.0), (3, 0.0, 1.0)) AS v(seq, dx, dy))"""
FIELD_SQL = """field AS (SELECT CAST(50.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (l_suppkey // 2000) + CAST(0.1 AS DOUBLE) * (l_linenumber - 4) AS lat,
   CAST(30.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * ((l_suppkey % 2000) // 5) AS lon, CAST(l_shipdate AS DATE) AS date,
   sum(l_quantity) AS prcp, round(avg(l_discount) * 400.0 - 20.0, 6) AS t FROM lineitem GROUP BY 1, 2, 3)"""
