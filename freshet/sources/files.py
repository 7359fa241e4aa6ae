"""Readers and writers for the file layouts the data set comes in and goes out as."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import finer
from ..functions.stats import nan_to_null
from . import stations


def read_attributes(spark: SparkSession, path: str, ids: DataFrame | None = None, id_col: str = "series_id") -> DataFrame:
    """Attribute CSV with a text id and numeric columns, limited to the ids given."""
    header = spark.read.option("header", True).csv(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == id_col else T.DoubleType()) for f in header])
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df if ids is None else df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def read_series_folder(spark: SparkSession, path: str, value: str, date: str = "date") -> DataFrame:
    """One CSV per series, the id in the file name, into one long table in a single scan.

    A file that lacks the value column contributes no rows.
    """
    raw = spark.read.text(path, pathGlobFilter="*.csv").select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1).alias("series_id"), "_metadata.file_path", "value"
    )
    head = raw.where(F.col("value").rlike(f"(^|,){date}(,|$)")).groupBy("file_path").agg(F.min("value").alias("_h"))
    cells = raw.join(head, "file_path").where(F.col("value") != F.col("_h"))
    at = lambda c: F.array_position(F.split("_h", ","), F.lit(c)).cast("int")
    parts = F.split("value", ",")
    out = cells.select(
        "series_id", F.try_element_at(parts, at(date)).try_cast("date").alias("date"),
        F.when(at(value) > 0, F.try_element_at(parts, F.greatest(at(value), F.lit(1)))).alias("_v"), at(value).alias("_p"),
    ).where("_p > 0 AND date IS NOT NULL")
    return nan_to_null(out.select("series_id", "date", F.col("_v").try_cast("double").alias("value")))


def read_station_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of header-and-body station files: ``(file, line_no, line)``."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("line_no"),
        F.col("value").alias("line"),
    )


def write_station_files(df: DataFrame, path: str, country: str = "country", mode: str = "append") -> None:
    """One header-and-body file per series of ``(series_id, date, value, country)``, as ``stations`` reads them.

    A series is bounded by the calendar, so it fits the task that sorts its lines.
    """
    # The number that stands for a missing value, and its format.
    number = F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")).otherwise("-999.000")
    line = F.concat_ws(";", F.date_format("date", "yyyy-MM-dd"), F.lit("--:--"), number)
    stations.register(df.sparkSession)
    # Few bytes make many files, so the parts keep the session's number.
    lines = finer(df.select("series_id", F.col(country).cast("string").alias("country"), "date", line.alias("line")), "series_id", times=1)
    lines.sortWithinPartitions("series_id", "date").select(F.col("series_id").cast("string"), "country", "line").write.format("station_files").mode(mode).save(path)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, digest)`` of every file under a folder."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return b.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("digest"))


def write_series(df: DataFrame, path: str, buckets: int | None = None, mode: str = "overwrite") -> None:
    """Long table clustered for later scans: hash bucket folders, sorted by series and day inside.

    As many buckets as the session has shuffle partitions; a bucket too large for one task is cut by Spark.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.withColumn("series_bucket", F.pmod(F.xxhash64("series_id"), F.lit(n)))
        .hint("rebalance", "series_bucket")
        .sortWithinPartitions("series_id", "date")
        .write.mode(mode).partitionBy("series_bucket").parquet(path)
    )


def write_months(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder per (year, month).  Months already on disk are kept unless ``overwrite``."""
    spark = df.sparkSession
    out = df.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    if not overwrite:
        try:
            have = spark.read.parquet(path).select("year", "month").distinct()
            out = out.join(have, ["year", "month"], "left_anti")
        except Exception as e:  # the folder does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    # A month is spread over tasks that AQE sizes, and a large one over several of them.
    out.hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def write_by_grade(df: DataFrame, grades: DataFrame, path: str, keys: Sequence[str] = ("series_id",)) -> None:
    """Route each series to the folder of its overall grade."""
    j = df.join(grades.select(*keys, F.col("overall_grade").alias("grade")), list(keys), "left")
    j.withColumn("grade", F.coalesce("grade", F.lit("ungraded"))).write.mode("overwrite").partitionBy("grade").parquet(path)


def read_by_grade(spark: SparkSession, path: str, wanted: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Series of the wanted grades; unknown column names are ignored, other folders are not scanned."""
    df = spark.read.parquet(path).where(F.col("grade").isin(*wanted))
    if columns is None:
        return df
    keep = [c for c in df.columns if c in ("series_id", "date", "grade", *columns)]
    return df.select(*keep)
