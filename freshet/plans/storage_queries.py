"""Queries that write a layout or run a stateful stream and read the result back.

All of them write below the shared folder the session names (see ``streams.scratch``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as FI
from ..sources import stations as SF
from ..sources import tables as T
from ..streaming import streams as ST
from .ingest_queries import OV, _grades
from .quality_queries import D, SNOW, daily
from .registry import query


@query("src_month_partitions", "SRC-17 ING-36", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2""", "total")
def src_month_partitions(spark, sf):
    path = ST.scratch(spark)
    o = T.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    FI.write_months(o, path)
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("src_grade_folders", "SRC-03 SRC-04 SRC-22", f"WITH {OV} SELECT o.series_id, date, value, overall AS grade FROM o JOIN ov USING (series_id) WHERE overall IN ('A', 'B')", "value", "date")
def src_grade_folders(spark, sf):
    path = ST.scratch(spark)
    FI.write_by_grade(T.supplier_flow(spark, sf), _grades(spark, sf), path)
    return FI.read_by_grade(spark, path, ["A", "B"], ["value", "absent"])


STATION_SQL = """SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CASE l_suppkey % 3 WHEN 0 THEN 'RU' WHEN 1 THEN 'FI' ELSE 'NO' END AS country, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2, 3 HAVING sum(l_quantity) < 60"""


def station_days(spark, sf):
    """Days of every supplier; large values count as missing, so the files hold both kinds of lines."""
    country = F.element_at(F.array(F.lit("RU"), F.lit("FI"), F.lit("NO")), F.col("series_id").cast("int") % 3 + 1)
    return T.supplier_flow(spark, sf).select("series_id", "date", F.when(F.col("value") < 60, F.col("value")).alias("value"), country.alias("country"))


@query("src_station_files", "SRC-02 SRC-18 SRC-19", f"SELECT * FROM ({STATION_SQL}) WHERE country = 'RU'", "value", "date")
def src_station_files(spark, sf):
    """Station files of all suppliers, written, and those of one country read through the data source."""
    path = ST.scratch(spark)
    FI.write_station_files(station_days(spark, sf), path)
    SF.register(spark)
    found = spark.read.format("station_files").option("path", path).load()
    return found.where("country = 'RU'").select("series_id", "country", "date", "value")


@query("str_station_files", "SRC-18 STR-02", f"SELECT series_id, count(*) AS n, sum(value) AS total, min(date) AS first_day, max(date) AS last_day FROM ({STATION_SQL}) GROUP BY 1", "total", "first_day last_day")
def str_station_files(spark, sf):
    """Station files in two deliveries, each drained by the same stream from its checkpoint."""
    path = ST.scratch(spark)
    days = station_days(spark, sf)
    SF.register(spark)
    for part in ("country = 'NO'", "country <> 'NO'"):
        FI.write_station_files(days.where(part), f"{path}/in")
        stream = spark.readStream.format("station_files").option("path", f"{path}/in").option("settle", "0").load()
        out = ST.run_available(stream.select("series_id", "date", "value"), f"{path}/run")
    return out.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("str_snow_storage", "STR-05 MR-04", f"WITH {D}, {SNOW(k='series_id')} SELECT series_id, date, rain_input, snow_input, melt_input, snowpack_proxy FROM sn", "rain_input snow_input melt_input snowpack_proxy", "date")
def str_snow_storage(spark, sf):
    """The snow partition as a stream with one storage value per series as state.

    Days arrive in order of time in three deliveries; the stream stops after each and goes on from its checkpoint.
    """
    path, key = ST.scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    days = daily(spark, sf).select("series_id", "date", "p", "t")
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ("date < DATE'1994-06-01'", "date >= DATE'1994-06-01' AND date < DATE'1996-09-15'", "date >= DATE'1996-09-15'"):
            days.where(part).write.mode("append").parquet(f"{path}/in")
            out = ST.run_available(ST.snow_stream(ST.read_stream(spark, f"{path}/in")), f"{path}/run")
        return out
    finally:
        spark.conf.set(key, old)


@query("str_month_upsert", "STR-02 ING-35", f"""WITH {D}, x AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month FROM d), c AS (SELECT month FROM x WHERE value >= 60 GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM d))
  SELECT series_id, date, CASE WHEN value >= 60 THEN value END AS value, month FROM x SEMI JOIN c USING (month)""", "value", "date month")
def str_month_upsert(spark, sf):
    """Only months in which every series holds a large value count as covered and are stored."""
    path = ST.scratch(spark)
    days = daily(spark, sf).select("series_id", "date", F.when(F.col("value") >= 60, F.col("value")).alias("value"))
    # Four files, one per micro-batch, cut across months and series.
    days.repartition(4, F.xxhash64("series_id", "date")).write.parquet(f"{path}/in")
    q = (
        ST.read_stream(spark, f"{path}/in", max_files=1).writeStream.foreachBatch(ST.month_upsert(f"{path}/out"))
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")
