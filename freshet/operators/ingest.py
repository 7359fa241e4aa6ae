"""Record cleaning, block reshaping, merging, gap filling and provenance flags."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import runs as R
from ..functions.skew import finer
from ..functions import stats as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("series_id",)
# No-data sentinel, cell codes for dried-up and frozen-through, longest bridged gaps.
SENTINEL = -9999.0
DRY, FROZEN = "прсх", "прмз"
GAP_RIVER, GAP_RESERVOIR = 6, 15
OBSERVED, FILLED, ZERO_REPLACED, MISSING = 0, 1, 2, 3


def val() -> Column:
    return F.col("value")



# --- cells and blocks ---------------------------------------------------------------------------------


def clean_cell(text: Column) -> Column:
    """Cell text to numeric text: codes to 0, comma to dot, everything else stripped (signs too)."""
    s = F.coalesce(text, F.lit(""))
    for code in (DRY, FROZEN):
        s = F.replace(s, F.lit(code), F.lit("0"))
    return F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), "[^0-9.]", "")


def cell_value(text: Column) -> Column:
    """Cleaned text to number: blank is the sentinel, unparsable text is null."""
    s = F.rtrim(text, F.lit("-"))
    return F.when(F.length(F.trim(s)) == 0, F.lit(SENTINEL)).otherwise(s.try_cast("double"))


def split_blocks(rows: DataFrame, stride: int, body: int, year: int, site: int, label: int, extra: int | None = None) -> DataFrame:
    """Cut sheet rows ``(file, row, c0…c12)`` into fixed-stride blocks.

    Offsets are relative to the start of a block.  Header cells stand in column ``c1``.  The
    result has one row per body line: ``(file, block, series_id, label, year, day, m1…m12[, extra])``.
    """
    off = F.col("row") % stride
    block = F.floor(F.col("row") / stride)
    w = Window.partitionBy("file", "block")
    head = lambda o: F.max(F.when(F.col("off") == o, F.col("c1"))).over(w)
    base = rows.select("*", off.alias("off"), block.alias("block"))
    cols = [head(site).alias("series_id"), head(label).alias("label"), head(year).try_cast("int").alias("year")]
    if extra is not None:
        cols.append(head(extra).try_cast("double").alias("extra"))
    base = base.select("file", "block", "off", *cols, *[F.col(f"c{i}").alias(f"m{i}") for i in range(1, 13)])
    return base.where(F.col("off").between(body, body + 30)).withColumn("day", F.col("off") - body + 1).drop("off")


def unpivot_blocks(blocks: DataFrame) -> DataFrame:
    """Day-by-month blocks to one row per cell, cleaned, padding cells of short months dropped.

    A blank 29 February takes the integer mean of the first 28 days when all of them are whole
    numbers; a lone dot takes the mean of its neighbours in the month (one-sided at the ends).
    """
    keep = [c for c in blocks.columns if c[0] != "m" or not c[1:].isdigit()]
    months = F.array(*[F.struct(F.lit(i).alias("month"), clean_cell(F.col(f"m{i}")).alias("text")) for i in range(1, 13)])
    long = blocks.select(*keep, F.explode(months).alias("x")).select(*keep, "x.month", "x.text")
    last = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1))))
    long = long.where(F.col("day") <= last)
    block = ["file", "block", "series_id", "year"]
    w = Window.partitionBy(*block, "month")
    feb = F.when((F.col("month") == 2) & (F.col("day") <= 28), F.col("text"))
    ints = F.count(F.when(feb.rlike("^[0-9]+$"), feb)).over(w)
    feb_mean = F.avg(feb.try_cast("double")).over(w)
    fix = (F.col("month") == 2) & (F.col("day") == 29) & (F.col("text") == "") & (ints == 28)
    long = long.withColumn("text", F.when(fix, F.floor(feb_mean).cast("string")).otherwise(F.col("text")))
    order = w.orderBy("day")
    prev, nxt = F.lag("text").over(order).try_cast("double"), F.lead("text").over(order).try_cast("double")
    dot = (F.coalesce(prev, nxt) + F.coalesce(nxt, prev)) / 2
    return long.withColumn("value", F.when(F.col("text") == ".", dot).otherwise(cell_value(F.col("text"))))


def daily_from_blocks(blocks: DataFrame) -> DataFrame:
    """Daily rows of every block whose cells all parse; sentinel cells become null."""
    cells = unpivot_blocks(blocks)
    w = Window.partitionBy("file", "block", "series_id", "year")
    bad = F.count_if(val().isNull()).over(w)
    ok = cells.withColumn("_bad", bad).where("_bad = 0").drop("_bad", "text")
    return ok.withColumn("date", F.make_date("year", "month", "day")).withColumn("value", F.nullif(val(), F.lit(SENTINEL)))


# --- merging ---------------------------------------------------------------------------------------------


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in the given order, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def merge_fragments(
    fragments: DataFrame, keys: Sequence[str] = KEY, start: str | None = None, end: str | None = None, order: str = "file"
) -> DataFrame:
    """Coalesce fragments ``(keys, date, value, file)`` onto a daily calendar, first file wins per cell.

    Without bounds the calendar of a series runs from its first to its last fragment day.
    """
    k = list(keys)
    cells = fragments.where(val().isNotNull()).groupBy(*k, "date").agg(F.min_by("value", order).alias("value"))
    span = fragments.groupBy(*k).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    grid = C.dense_days(span, start, end, keys)
    return finer(grid, *k, "date").join(finer(cells, *k, "date"), [*k, "date"], "left")


def coalesce_tables(first: DataFrame, second: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cell-wise upsert: values of ``first`` win, gaps come from ``second``."""
    a = first.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = second.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.join(b, list(keys), "full_outer").select(*keys, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in columns])


def build_compound(flow: DataFrame, stage: DataFrame, sites: DataFrame) -> DataFrame:
    """Join flow and stage on the day; depth from the area, absolute level from the datum.

    ``flow (series_id, date, q_cms)``, ``stage (series_id, date, lvl_cm)``,
    ``sites (series_id, area_km2, datum)``.
    """
    both = flow.join(stage, ["series_id", "date"], "full_outer").join(sites, "series_id", "left")
    return both.select(
        "series_id", "date", "q_cms", "lvl_cm",
        F.when(F.col("area_km2") > 0, F.col("q_cms") * 86400 / (F.col("area_km2") * 1e3)).alias("q_mm_day"),
        (F.col("datum") + F.col("lvl_cm") / 100.0).alias("lvl_abs"),
    )


# --- gap filling ---------------------------------------------------------------------------------------------


def gap_runs(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Length of the null run of every row and whether it lies strictly inside the data."""
    w = R.ordered(keys)
    null = val().isNull()
    marked = R.mark_runs(df, null, keys, contiguous=False, prefix="gap")
    length = F.sum(F.col("gap_flag").cast("int")).over(Window.partitionBy(*keys, "gap_id"))
    before = F.max(val()).over(w.rowsBetween(Window.unboundedPreceding, -1)).isNotNull()
    after = F.max(val()).over(w.rowsBetween(1, Window.unboundedFollowing)).isNotNull()
    return marked.select(*df.columns, F.when(null, length).otherwise(0).alias("gap_length"), (null & before & after).alias("gap_inside"))


def _quadratic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating quadratic spline with knots midway between the data sites.

    Every interior site meets three basis functions, so the coefficients solve a tridiagonal
    system.
    """
    n = len(x)
    t = np.concatenate([[x[0]] * 3, (x[1:-2] + x[2:-1]) / 2, [x[-1]] * 3])

    def basis(p: np.ndarray, span: np.ndarray) -> np.ndarray:
        b = np.zeros((3, len(p)))
        d = lambda a: t[span + a]
        left = (d(1) - p) / (d(1) - d(0))
        right = 1.0 - left
        b[0] = left * (d(1) - p) / (d(1) - d(-1))
        b[1] = left * (p - d(-1)) / (d(1) - d(-1)) + right * (d(2) - p) / (d(2) - d(0))
        b[2] = right * (p - d(0)) / (d(2) - d(0))
        return b

    def span_of(p: np.ndarray) -> np.ndarray:
        return np.clip(np.searchsorted(t, p, side="right") - 1, 2, n - 1)

    rows = basis(x, span_of(x))
    start = span_of(x) - 2
    lo, mid, up = np.zeros(n), np.zeros(n), np.zeros(n)
    for j in range(n):
        for m in range(3):
            c = start[j] + m
            if c == j - 1:
                lo[j] = rows[m, j]
            elif c == j:
                mid[j] = rows[m, j]
            elif c == j + 1:
                up[j] = rows[m, j]
    coef = y.astype(float).copy()
    for j in range(1, n):
        f = lo[j] / mid[j - 1]
        mid[j] -= f * up[j - 1]
        coef[j] -= f * coef[j - 1]
    coef[-1] /= mid[-1]
    for j in range(n - 2, -1, -1):
        coef[j] = (coef[j] - up[j] * coef[j + 1]) / mid[j]
    s = span_of(at)
    b = basis(at, s)
    return b[0] * coef[s - 2] + b[1] * coef[s - 1] + b[2] * coef[s]


def fill_short_gaps(df: DataFrame, max_gap: int = GAP_RIVER, keys: Sequence[str] = KEY) -> DataFrame:
    """Fill whole null runs of at most ``max_gap`` rows strictly inside the data.

    The spline runs through all observed days of the series, so it is a grouped step; which cells
    are filled is decided by windows and returned as ``was_filled``.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    tagged = gap_runs(df.select(*keys, "date", val().cast("double").alias("value")), keys)
    tagged = tagged.select(
        *keys, "date", "value", (F.col("gap_inside") & (F.col("gap_length") <= max_gap)).alias("was_filled")
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        day = pd.to_datetime(pdf["date"]).to_numpy().astype("datetime64[D]").astype(float)
        y = pdf["value"].to_numpy(float)
        seen, todo = ~np.isnan(y), pdf["was_filled"].to_numpy(bool)
        if todo.any() and seen.sum() >= 3:
            y = y.copy()
            y[todo] = _quadratic_spline(day[seen], y[seen], day[todo])
        else:
            todo = np.zeros(len(y), dtype=bool)
        return pdf.assign(value=y, was_filled=todo)

    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", date date, value double, was_filled boolean"
    return tagged.groupBy(*keys).applyInPandas(one, ddl).withColumn("value", F.nanvl(val(), F.lit(None)))


def clean_discharge(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """First value per day, negatives to null, short gaps filled."""
    once = df.groupBy(*keys, "date").agg(F.min_by("value", "file").alias("value"))
    return fill_short_gaps(once.withColumn("value", F.when(val() >= 0, val())), GAP_RIVER, keys)


def replace_zeros(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Zero values become the median of the non-zero values of the same calendar day."""
    w = Window.partitionBy(*keys, F.month("date"), F.dayofmonth("date"))
    med = S.quantile(F.when(val() != 0, val()), 0.5).over(w)
    return df.select(*[c for c in df.columns if c != "value"], F.when(val() == 0, med).otherwise(val()).alias("value"))


def clean_level(df: DataFrame, keys: Sequence[str] = KEY, reservoir: bool = False) -> DataFrame:
    """First value per day, zeros replaced, short gaps filled (longer bridges for reservoirs)."""
    once = df.groupBy(*keys, "date").agg(F.min_by("value", "file").alias("value"))
    return fill_short_gaps(replace_zeros(once, keys), GAP_RESERVOIR if reservoir else GAP_RIVER, keys)


def climatology_fill(
    df: DataFrame, columns: Sequence[str], years: tuple[int, int], min_years: int = 3, keys: Sequence[str] = KEY
) -> DataFrame:
    """Fill nulls with the day-of-year mean of the donor years where enough of them hold a value."""
    w = Window.partitionBy(*keys, F.dayofyear("date"))
    donor = F.year("date").between(*years)
    out = df
    for c in columns:
        x = F.when(donor, F.col(c))
        fill = F.when(F.count(x).over(w) >= min_years, F.avg(x).over(w))
        out = out.withColumn(f"{c}_filled", F.col(c).isNull() & fill.isNotNull()).withColumn(c, F.coalesce(F.col(c), fill))
    return out


def fill_counts(filled: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Filled cells per column and the provenance note of series where anything was filled."""
    out = filled.groupBy(*keys).agg(*[F.count_if(f"{c}_filled").alias(f"n_{c}") for c in columns])
    total = sum((F.col(f"n_{c}") for c in columns), F.lit(0))
    return out.withColumn("note", F.when(total > 0, F.concat(F.lit("day-of-year fill: "), total.cast("string"), F.lit(" cells"))))


def splice(df: DataFrame, donor: DataFrame, columns: Sequence[str], before_year: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Fill nulls before a year from another series of the same keys and days."""
    d = donor.select(*keys, "date", *[F.col(c).alias(f"_d_{c}") for c in columns])
    early = F.year("date") < before_year
    j = df.join(d, [*keys, "date"], "left")
    return j.select(
        *[c for c in df.columns if c not in columns],
        *[F.when(F.col(c).isNull() & early, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
    )


# --- provenance --------------------------------------------------------------------------------------------------


def fill_mask(raw: DataFrame, shipped: DataFrame, keys: Sequence[str] = KEY, zeros: bool = False) -> DataFrame:
    """1 where the raw cell was empty and the shipped one is not; 2 where a raw zero was replaced.

    Series without any raw record are left at 0, as their provenance is unknown.
    """
    k = [*keys, "date"]
    known = raw.select(*keys).distinct().withColumn("_known", F.lit(True))
    j = shipped.select(*k, F.col("value").alias("_s")).join(raw.select(*k, F.col("value").alias("_r")), k, "left").join(known, list(keys), "left")
    code = F.when(F.col("_known").isNull() | F.col("_s").isNull(), 0)
    if zeros:
        code = code.when(F.col("_r") == 0, ZERO_REPLACED)
    return j.select(*k, code.when(F.col("_r").isNull(), FILLED).otherwise(0).cast("tinyint").alias("fill_mask"))


def edge_fills(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mark filled runs that do not have an observed row on both sides, from ``(present, filled)``."""
    w = R.ordered(keys)
    seen = F.col("present") & ~F.col("filled")
    base = R.mark_runs(finer(df, *keys).withColumn("_obs", seen), F.col("filled"), keys, contiguous=False, prefix="fr")
    base = base.select("*", F.lag("_obs").over(w).alias("_lo"), F.lead("_obs").over(w).alias("_hi"), F.lead("fr_flag").over(w).alias("_nf"))
    run = Window.partitionBy(*keys, "fr_id")
    left = F.max(F.when(F.col("fr_first"), F.coalesce("_lo", F.lit(False)))).over(run)
    closes = F.col("fr_flag") & ~F.coalesce("_nf", F.lit(False))
    right = F.max(F.when(closes, F.coalesce("_hi", F.lit(False)))).over(run)
    return base.select(*df.columns, (F.col("fr_flag") & ~(left & right)).alias("edge"))


def blank_cells(df: DataFrame, cells: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Null the value of the listed (key, day) cells."""
    k = [*keys, "date"]
    hit = cells.select(*k).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, k, "left").withColumn("value", F.when(F.col("_hit").isNull(), val())).drop("_hit")


def quality_codes(present: Column, filled: Column) -> Column:
    """0 observed, 1 filled, 3 missing; absence wins over the fill mark."""
    return F.when(~present, MISSING).when(filled, FILLED).otherwise(OBSERVED).cast("tinyint")


def out_of_range(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mark altered values outside the observed range of their own series."""
    w = Window.partitionBy(*keys)
    seen = F.when(F.col("flag") == OBSERVED, val())
    altered = F.col("flag").isin(FILLED, ZERO_REPLACED) & val().isNotNull()
    outside = (val() < F.min(seen).over(w)) | (val() > F.max(seen).over(w))
    return df.withColumn("out_of_range", F.coalesce(altered & outside, F.lit(False)))


def reversion_counts(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Reverted cells by origin and negative values, per series with any."""
    r = F.col("out_of_range")
    return out_of_range(df, keys).groupBy(*keys).agg(
        F.count_if(r).alias("n_reverted"), F.count_if(r & (F.col("flag") == FILLED)).alias("n_from_fill"),
        F.count_if(r & (F.col("flag") == ZERO_REPLACED)).alias("n_from_zero"), F.count_if(val() < 0).alias("n_negative"),
        F.count_if((val() < 0) & ~r).alias("n_negative_kept"),
    ).where("n_reverted > 0")


def specific_anomaly(df: DataFrame, keys: Sequence[str] = KEY, limit: float = 20.0) -> DataFrame:
    """1 where the median depth exceeds the limit, 0 otherwise, -1 without data."""
    m = S.quantile(val(), 0.5)
    return df.groupBy(*keys).agg(F.when(m.isNull(), -1).when(m > limit, 1).otherwise(0).cast("int").alias("anomaly"))


# --- forcing ingest ------------------------------------------------------------------------------------------------


def hourly_to_daily(df: DataFrame, keys: Sequence[str] = KEY, offset: float = -273.15) -> DataFrame:
    """Daily mean, minimum and maximum of ``(keys, ts, value)`` in shifted units."""
    x = val() + offset
    return df.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.avg(x).alias("t_mean"), F.min(x).alias("t_min"), F.max(x).alias("t_max")
    )


def deaccumulate(df: DataFrame, keys: Sequence[str] = KEY, full_step: int = 24) -> DataFrame:
    """Daily total of accumulated steps ``(keys, date, step, value)``: the full step, else the last one."""
    best = F.struct((F.col("step") == full_step).cast("int"), "step")
    return df.groupBy(*keys, "date").agg(F.max_by("value", best).alias("value"))


def heal_days(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per day from overlapping files: the largest non-null value."""
    return df.groupBy(*keys, "date").agg(F.max("value").alias("value"))


def closed_months(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Months that may be finalised: a later month has arrived and no day is all null.

    A day is all null when no series holds a value on it.
    """
    day = df.groupBy(F.to_date(F.trunc("date", "month")).alias("month"), "date").agg(F.count("value").alias("n"))
    m = day.groupBy("month").agg(F.min("n").alias("least"), F.count("*").alias("n_days"))
    # One row per calendar month: the ordering window holds months, not records.
    nxt = F.lead("month").over(Window.partitionBy().orderBy("month"))
    return m.select("month", "n_days", (nxt == F.add_months("month", 1)).alias("has_next"), (F.col("least") > 0).alias("complete")).withColumn(
        "closed", F.coalesce("has_next", F.lit(False)) & F.col("complete")
    )


def covered_months(df: DataFrame, column: str = "value", keys: Sequence[str] = KEY) -> DataFrame:
    """Months in which every series holds a value; an all-null month does not count."""
    m = F.to_date(F.trunc("date", "month")).alias("month")
    per = df.groupBy(*keys, m).agg((F.count(column) > 0).alias("has"))
    n = df.select(*keys).distinct().agg(F.count("*").alias("n_ids"))
    got = per.groupBy("month").agg(F.count_if("has").alias("n_has"))
    # ``n`` is a single row.
    return got.join(F.broadcast(n)).where("n_has = n_ids").select("month")


def in_months(df: DataFrame, first: tuple[int, int], last: tuple[int, int], year: str = "year", month: str = "month") -> DataFrame:
    """Keep partitions between two (year, month) pairs, as a predicate partition pruning understands."""
    y, m = F.col(year), F.col(month)
    lo = (y > first[0]) | ((y == first[0]) & (m >= first[1]))
    hi = (y < last[0]) | ((y == last[0]) & (m <= last[1]))
    return df.where(y.between(first[0], last[0]) & lo & hi)


def renormalise(df: DataFrame, columns: Sequence[str], coverage: str) -> DataFrame:
    """Divide attribute columns by the covered fraction."""
    return df.select(*[S.div(F.col(c), F.col(coverage)).alias(c) if c in columns else F.col(c) for c in df.columns])


def coverage_tracking(df: DataFrame, parts: Sequence[str], coverage: str, limit: float = 0.3) -> DataFrame:
    """Correlation of a fraction sum with the coverage; below the limit nothing is left to divide."""
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    return df.agg(S.corr(total, F.col(coverage)).alias("r")).withColumn("already_done", F.abs("r") < limit)


def classify_coverage(
    df: DataFrame, start: str, end: str, keys: Sequence[str] = KEY
) -> DataFrame:
    """empty / partial / full coverage of a period, with null and data marks."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = F.col("date").between(lo, hi)
    out = df.groupBy(*keys).agg(
        (F.count(val()) > 0).alias("has_data"), (F.count(val()) < F.count("*")).alias("has_nulls"),
        F.min(F.when(inside, F.col("date"))).alias("a"), F.max(F.when(inside, F.col("date"))).alias("b"),
        F.count_if(inside & val().isNull()).alias("holes"),
    )
    full = (F.col("a") == lo) & (F.col("b") >= hi) & (F.col("holes") == 0)
    return out.select(
        *keys, F.when(~F.col("has_data"), "empty").when(full, "full").otherwise("partial").alias("status"),
        (F.col("has_data") & F.col("has_nulls")).alias("has_nulls"), "has_data",
    )


def null_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Null share and range of each column per series."""
    aggs = []
    for c in columns:
        aggs += [(1 - F.count(c) / F.count("*")).alias(f"{c}_null_frac"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*aggs)
