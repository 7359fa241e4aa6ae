"""Calendar expressions: periods, hydrological years, seasons, dense day grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HYDRO_START = 10
SEASONS = ("winter", "spring", "summer", "autumn")


def hydro_year(date: Column, start_month: int = HYDRO_START) -> Column:
    """Label of the hydrological year that a day falls in (named after its last month)."""
    if start_month <= 1:
        return F.year(date)
    return F.year(date) + (F.month(date) >= start_month).cast("int")


def period(date: Column, kind: str = "hydrological", start_month: int = HYDRO_START) -> Column:
    """Calendar or hydrological year label."""
    if kind not in ("calendar", "hydrological"):
        raise ValueError(f"unknown period type: {kind}")
    return F.year(date) if kind == "calendar" else hydro_year(date, start_month)


def hydro_start(year: Column, start_month: int = HYDRO_START) -> Column:
    """First day of a hydrological year."""
    first = year - 1 if start_month > 1 else year
    return F.make_date(first, F.lit(max(start_month, 1)), F.lit(1))


def hydro_end(year: Column, start_month: int = HYDRO_START) -> Column:
    """Last day of a hydrological year."""
    return F.date_sub(F.add_months(hydro_start(year, start_month), 12), 1)


def hydro_length(year: Column, start_month: int = HYDRO_START) -> Column:
    """Number of days in a hydrological year."""
    return F.datediff(hydro_end(year, start_month), hydro_start(year, start_month)) + 1


def hydro_day(date: Column, start_month: int = HYDRO_START) -> Column:
    """1-based day within the hydrological year."""
    return F.datediff(date, hydro_start(hydro_year(date, start_month), start_month)) + 1


def season(date: Column) -> Column:
    """Meteorological season; December counts with its own calendar year."""
    m = F.month(date)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def season_code(date: Column) -> Column:
    """Season as its month initials (DJF, MAM, JJA, SON)."""
    m = F.month(date)
    return (
        F.when(m.isin(12, 1, 2), "DJF")
        .when(m.isin(3, 4, 5), "MAM")
        .when(m.isin(6, 7, 8), "JJA")
        .otherwise("SON")
    )


def daily_columns(df: DataFrame, date: str = "date") -> DataFrame:
    """Add month, day-of-year, year and hydrological year."""
    d = F.col(date)
    return df.select(
        "*",
        F.month(d).alias("month"),
        F.dayofyear(d).alias("day_of_year"),
        F.year(d).alias("year"),
        hydro_year(d).alias("hydro_year"),
    )


def dense_days(
    ids: DataFrame, start: str | None = None, end: str | None = None, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """One row per id and day.  With no bounds, ``ids`` must carry ``first_day`` / ``last_day``."""
    lo = F.lit(start).cast("date") if start else F.col("first_day")
    hi = F.lit(end).cast("date") if end else F.col("last_day")
    return ids.select(*keys, F.explode(F.sequence(lo, hi)).alias("date"))
