"""Query registry: a builder, an optional SQL counterpart and the rounding both share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
# Means over powers of two end exactly on a half unit; this shift moves them off the rounding edge.
SHIFT = 1.3e-8


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Round doubles, print dates and join arrays, so two engines can be compared by value."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c + F.lit(SHIFT), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def presentable_sql(sql: str, doubles: str, dates: str) -> str:
    parts = [f"round(CAST({c} AS DOUBLE) + CAST({SHIFT} AS DOUBLE), {DIGITS}) + CAST(0 AS DOUBLE) AS {c}" for c in doubles.split()]
    parts += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    if not parts:
        return sql
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) AS q"


def joined_sql(*parts: tuple[str, str]) -> str:
    """Join the SQL of several queries on ``series_id``; each part is (column prefix, name or SQL)."""
    out, keep = "", []
    for i, (prefix, part) in enumerate(parts):
        sql = REGISTRY[part].sql if part in REGISTRY else part
        named = f"(SELECT series_id AS k{i}, COLUMNS('(.*)') AS 'p{i}_{prefix}\\1' FROM ({sql}))"
        out += named if not out else f" JOIN {named} ON k0 = k{i}"
        keep.append(f"COLUMNS('p{i}_(.*)') AS '\\1'")
    inner = f"SELECT k0 AS _id, {', '.join(keep)} FROM {out}"
    return f"SELECT _id AS series_id, COLUMNS(lambda c: c <> '_id' AND NOT contains(c, 'series_id')) FROM ({inner})"


def query(name: str, covers: str, sql: str | None = None, doubles: str = "", dates: str = ""):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` lists inventory ids."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        full = presentable_sql(sql, doubles, dates) if sql else None
        REGISTRY[name] = Query(name, lambda spark, sf: presentable(fn(spark, sf)), full, covers)
        return fn

    return register
