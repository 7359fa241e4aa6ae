"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join with every key of ``big`` spread over ``salts`` parts by a hash of the ``spread`` columns.

    ``small`` is repeated once per part, so it should hold few rows per key.  ``how`` is ``inner``
    or ``left``.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return b.join(s, [*on, "_salt"], how).drop("_salt")


def hot_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], weight: str, total: int, salts: int = SALTS) -> DataFrame:
    """Inner join in which only the keys that hold many rows of ``big`` are spread.

    ``small`` has one row per key, with the number of ``big``'s rows in column ``weight`` (dropped from
    the result); ``total`` is the sum of those numbers.  A key is hot if it holds more than a quarter of an
    even partition, so there are at most ``4 x partitions`` hot keys, and the broadcast of them is bounded.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = F.lit(max(1, total // (4 * parts)))
    hot = F.broadcast(small.where(F.col(weight) > limit).select(*on, F.lit(salts).alias("_salts")))
    b = big.join(hot, list(on), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts").cast("long")), F.lit(0).cast("long")))
    last = F.when(F.col(weight) > limit, salts - 1).otherwise(0).cast("long")
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return b.join(s, [*on, "_salt"]).drop("_salt", "_salts", weight)


def finer(df: DataFrame, *keys: str, times: int = 4) -> DataFrame:
    """Shuffle by ``keys`` into several times the session's partitions, for sorts of tables that are much longer than their input."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
