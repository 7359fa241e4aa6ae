"""Gaps and islands over daily rows.

All run bookkeeping is done with windows on ``(keys, date)``.  Every helper keeps the rows
hash-partitioned by ``keys``, so a later ``groupBy(keys)`` or ``groupBy(keys, run_id)`` reuses
the same exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def upto(keys: Sequence[str], order: str = "date"):
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def mark_runs(
    df: DataFrame,
    flag: Column,
    keys: Sequence[str] = ("series_id",),
    order: str = "date",
    contiguous: bool = True,
    prefix: str = "run",
) -> DataFrame:
    """Number the runs of rows where ``flag`` holds.

    Adds ``<prefix>_flag`` (bool), ``<prefix>_first`` (row opens a run) and ``<prefix>_id`` (run
    number, also carried by the unflagged rows after a run).  With ``contiguous`` a date step
    other than one day closes a run; otherwise only an unflagged row does.
    """
    w = ordered(keys, order)
    f, first, rid = f"{prefix}_flag", f"{prefix}_first", f"{prefix}_id"
    joined = F.coalesce(F.lag(f).over(w), F.lit(False))
    if contiguous:
        joined = joined & F.coalesce(F.datediff(F.col(order), F.lag(order).over(w)) == 1, F.lit(False))
    out = df.withColumn(f, F.coalesce(flag, F.lit(False)))
    out = out.withColumn(first, F.col(f) & ~joined)
    return out.withColumn(rid, F.sum(F.col(first).cast("int")).over(upto(keys, order)))


def run_position(keys: Sequence[str], order: str = "date", prefix: str = "run") -> Column:
    """Length so far of a contiguous run, in days, on each flagged row."""
    start = F.last(F.when(F.col(f"{prefix}_first"), F.col(order)), ignorenulls=True).over(upto(keys, order))
    return F.when(F.col(f"{prefix}_flag"), F.datediff(F.col(order), start) + 1)


def event_table(
    df: DataFrame,
    flag: Column,
    keys: Sequence[str] = ("series_id",),
    order: str = "date",
    contiguous: bool = True,
    aggs: Sequence[Column] = (),
) -> DataFrame:
    """One row per run: ``start``, ``end``, ``n_rows`` and any extra aggregates."""
    marked = mark_runs(df, flag, keys, order, contiguous)
    return (
        marked.where("run_flag")
        .groupBy(*keys, "run_id")
        .agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n_rows"), *aggs)
    )


def elapsed_duration(flag: Column, keys: Sequence[str] = ("series_id",), order: str = "date") -> tuple[Column, Column]:
    """Elapsed-day rule for runs: ``(opens, days)`` expressions.

    A run ends at the first unflagged row (that day counts, gaps are spanned); a run that
    reaches the end of the record ends on the last row.
    """
    w = ordered(keys, order)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    opens = flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    nxt = F.first(F.when(~flag, F.col(order)), ignorenulls=True).over(ahead)
    end = F.coalesce(nxt, F.max(order).over(whole))
    return opens, F.when(opens, F.datediff(end, F.col(order)) + 1)
