"""Structured Streaming versions of the incremental jobs.

Every function takes a streaming (or static) DataFrame with a ``ts`` column and returns the
transformed one; ``run_available`` drains a stream into a folder with a checkpoint, so a restart
continues where it stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.lineage import cut, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("series_id",)


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """File-source stream over the parquet files of a folder that match a name pattern."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(folder)


def scratch(spark: SparkSession) -> str:
    """Fresh folder below the session's shared one."""
    return scratch_folder(spark, "stream")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there, write parquet, return the written table."""
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")


# --- windows ---------------------------------------------------------------------------------------------


def daily_extremes(events: DataFrame, keys: Sequence[str] = KEY, delay: str = "1 day", offset: float = 0.0) -> DataFrame:
    """Daily mean, minimum and maximum, emitted once the watermark has passed the day."""
    x = F.col("value") + offset
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", delay).groupBy(*keys, w).agg(
        F.avg(x).alias("t_mean"), F.min(x).alias("t_min"), F.max(x).alias("t_max")
    ).select(*keys, F.to_date("window.start").alias("date"), "t_mean", "t_min", "t_max")


def healed_days(events: DataFrame, keys: Sequence[str] = KEY, delay: str = "3 days") -> DataFrame:
    """Null-skipping daily maximum; late or repeated records inside the delay heal the day."""
    return events.withWatermark("ts", delay).groupBy(*keys, F.window("ts", "1 day")).agg(F.max("value").alias("value")).select(
        *keys, F.to_date("window.start").alias("date"), "value"
    )


def closing_periods(events: DataFrame, length: str = "10 days", delay: str = "31 days") -> DataFrame:
    """Totals per period, emitted only after records of a later period moved the watermark past it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length)).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.to_date("window.start").alias("period_start"), "n", "total")


def wet_sessions(events: DataFrame, threshold: float, gap: str = "3 days", keys: Sequence[str] = KEY, delay: str = "1 day") -> DataFrame:
    """Wet spells as sessions: records at or above the threshold, closed by a dry gap."""
    wet = events.where(F.col("value") >= threshold).withWatermark("ts", delay)
    return wet.groupBy(*keys, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        *keys, F.col("s.start").alias("start"), F.col("s.end").alias("closes"), "n", "total"
    )


# --- upsert ------------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at a path, or None before its first write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else None


def month_upsert(path: str, keys: Sequence[str] = KEY):
    """``foreachBatch`` function: keep at ``path`` the months in which every known series holds a value.

    All rows wait in ``path_pending``, by month.  A batch is merged with what is stored of its
    months, by series and day, new values winning and absent ones healed by old ones; coverage is
    judged on the merged months.  A series that was not known before (``path_series``) can take coverage away from any month,
    so such a batch judges all of them again.  The list of series is written last and every step
    replaces whole months, so replaying a batch leaves the same files.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark, k = batch.sparkSession, list(keys)
        new = batch.withColumn("month", F.to_date(F.trunc("date", "month")))
        ddl = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        pending, series = f"{path}_pending", f"{path}_series"
        by_month = lambda df, to, how: df.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("month").parquet(to)
        old, known = _stored(spark, pending, ddl(new)), _stored(spark, series, ddl(batch.select(*k)))
        ranked = new.withColumn("_age", F.lit(0))
        if old is not None:
            ranked = ranked.unionByName(old.join(new.select("month").distinct(), "month", "left_semi").withColumn("_age", F.lit(1)))
        rest = [c for c in new.columns if c not in (*k, "date", "month")]
        merged = cut(ranked.groupBy(*k, "date", "month").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in rest]).select(*new.columns))
        by_month(merged, pending, "dynamic")
        names = batch.select(*k).distinct()
        fresh = cut(names if known is None else names.join(known, k, "left_anti"))
        n_known = fresh.count() + (0 if known is None else known.distinct().count())
        again = not fresh.isEmpty()
        judged = spark.read.schema(ddl(new)).parquet(pending) if again else merged
        held = judged.where(F.col("value").isNotNull()).select("month", *k).distinct().groupBy("month").count()
        good = judged.join(held.where(F.col("count") == n_known).select("month"), "month", "left_semi")
        by_month(good, path, "static" if again else "dynamic")
        if again:
            fresh.write.mode("append").parquet(series)

    return upsert


# --- state -------------------------------------------------------------------------------------------------


class SnowStorage(StatefulProcessor):
    """Snow storage of each series, carried from batch to batch.

    Storage depends on the order of days: within a batch they are sorted, and a batch must not bring
    a day at or before the last one that its series has seen, which is an error.
    """

    def __init__(self, snow_temp: float = 0.0, melt_temp: float = 0.0, melt_factor: float = 3.0) -> None:
        self.snow_temp, self.melt_temp, self.melt_factor = snow_temp, melt_temp, melt_factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pack = handle.getValueState("snowpack", "pack double, last date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pack, last = self.pack.get() if self.pack.exists() else (0.0, None)
        days = pd.concat(list(rows)).sort_values("date")
        if last is not None and days["date"].iloc[0] <= last:
            raise ValueError(f"day {days['date'].iloc[0]} of series {key[0]} arrived after {last}")
        out = []
        for d, p, t in zip(days["date"], days["p"], days["t"]):
            rain = snow = melt = None
            if pd.notna(p) and pd.notna(t):
                p = max(float(p), 0.0)
                rain, snow = (0.0, p) if t <= self.snow_temp else (p, 0.0)
                pack += snow
                melt = min(pack, self.melt_factor * (t - self.melt_temp)) if t > self.melt_temp else 0.0
                pack -= melt
            out.append((key[0], d, rain, snow, melt, pack))
        self.pack.update((float(pack), days["date"].iloc[-1]))
        yield pd.DataFrame(out, columns=["series_id", "date", "rain_input", "snow_input", "melt_input", "snowpack_proxy"])

    def close(self) -> None:
        pass


def snow_stream(days: DataFrame, **kw) -> DataFrame:
    """Streaming snow partition over ``(series_id, date, p, t)``; needs the RocksDB state store."""
    return days.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=SnowStorage(**kw),
        outputStructType="series_id string, date date, rain_input double, snow_input double, melt_input double, snowpack_proxy double",
        outputMode="Append", timeMode="None",
    )
