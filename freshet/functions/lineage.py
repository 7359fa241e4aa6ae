"""Reliable storage for intermediate tables: checkpoints and scratch folders that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, FRESHET_SHARED or a folder in its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("FRESHET_SHARED")
    master = spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir or FRESHET_SHARED must name a folder that driver and executors share")
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/freshet-shared").rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/freshet-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
