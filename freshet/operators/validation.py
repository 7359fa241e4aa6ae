"""Comparing series, table versions, expected metrics, manifests and schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.quantiles import exact_quantiles
from .spatial import match_sites

KEY = ("series_id",)
ID_ALIASES = ("series_id", "site_id", "station_id", "gauge_id", "gauge", "id")


def compare_series(df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 30) -> DataFrame:
    """Agreement of ``value`` with ``reference`` on days where both are present, rounded for print.

    Correlation and efficiency to 4 places, bias to 1, error to 2; null below ``min_days``.
    """
    v, r = F.col("value"), F.col("reference")
    both = df.where(v.isNotNull() & r.isNotNull())
    n = F.count("*")
    ok = n >= min_days
    ss = F.sum((v - r) ** 2)
    tot = F.var_pop(r) * n
    corr = S.corr(v, r)
    return both.groupBy(*keys).agg(
        n.alias("overlap_days"), F.min("date").alias("overlap_start"), F.max("date").alias("overlap_end"),
        F.when(ok, F.round(F.when(~F.isnan(corr), corr), 4)).alias("r"),
        F.when(ok & (tot > 0), F.round(1 - S.div(ss, tot), 4)).alias("nse"),
        F.when(ok & (F.sum(r) > 0), F.round(100 * S.div(F.sum(v - r), F.sum(r)), 1)).alias("pbias"),
        F.when(ok, F.round(F.sqrt(ss / n), 2)).alias("rmse"),
        F.when(ok, F.round(F.avg(r), 1)).alias("reference_mean"), F.when(ok, F.round(F.avg(v), 1)).alias("value_mean"),
    )


def validate_external(stations: DataFrame, sites: DataFrame, station_daily: DataFrame, site_daily: DataFrame, **kw) -> DataFrame:
    """Match stations to sites, join their daily series and compare them."""
    m = match_sites(stations, sites, **kw)
    ref = station_daily.select(F.col("id").alias("station_id"), "date", F.col("value").alias("reference"))
    own = site_daily.select(F.col("id").alias("site_id"), "date", "value")
    j = m.join(ref, "station_id").join(own, ["site_id", "date"])
    return compare_series(j, ["station_id", "site_id"])


def inventory(stations: DataFrame, matches: DataFrame, compared: DataFrame) -> DataFrame:
    """Stations, matched stations and matches with enough shared days."""
    a = stations.agg(F.count("*").alias("n_stations"))
    b = matches.agg(F.count("*").alias("n_matched"))
    c = compared.agg(F.count_if(F.col("r").isNotNull()).alias("n_compared"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


# --- table versions ----------------------------------------------------------------------------------------


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns that differ in presence or type between two versions."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    rows = [(c, a.get(c, ""), b.get(c, "")) for c in sorted(set(a) | set(b)) if a.get(c) != b.get(c)]
    return old.sparkSession.createDataFrame(rows, "column string, old_type string, new_type string")


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed by key, null-safe and NaN-safe, as one summary row."""
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    side = lambda d, p: d.select(*keys, F.lit(True).alias(f"_{p}"), F.struct(*shared).alias(f"_{p}v"))
    j = side(old, "o").join(side(new, "n"), list(keys), "full_outer")
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    same = F.col("_ov").eqNullSafe(F.col("_nv"))
    return j.agg(
        F.count_if(F.col("_o").isNull()).alias("n_added"), F.count_if(F.col("_n").isNull()).alias("n_removed"),
        F.count_if(both & ~same).alias("n_changed"), F.count_if(both & same).alias("n_equal"),
    ).withColumn("identical", (F.col("n_added") + F.col("n_removed") + F.col("n_changed")) == 0)


def exact_revision(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows present in only one of two versions, duplicates counted."""
    a = old.exceptAll(new.select(old.columns)).withColumn("side", F.lit("old"))
    b = new.select(old.columns).exceptAll(old).withColumn("side", F.lit("new"))
    return a.unionByName(b)


def metric_check(expected: DataFrame, actual: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``(metric, expected, actual, ok)``: every metric must exist on both sides and agree."""
    j = expected.select("metric", F.col("value").alias("expected")).join(
        actual.select("metric", F.col("value").alias("actual")), "metric", "full_outer"
    )
    close = F.abs(F.col("expected") - F.col("actual")) <= tolerance
    return j.withColumn("ok", F.coalesce(close, F.lit(False)))


def check_gate(checks: DataFrame) -> DataFrame:
    """Passed and failed checks."""
    return checks.agg(F.count_if("ok").alias("n_passed"), F.count_if(~F.col("ok")).alias("n_failed"))


def require(checks: DataFrame) -> None:
    """Raise when any check fails: how many, and the first few by name; ``checks`` itself lists them all."""
    bad = checks.where(~F.col("ok"))
    n = bad.count()
    if n:
        names = ", ".join(r["metric"] for r in bad.orderBy("metric").take(10))
        raise ValueError(f"{n} metric checks failed: {names}{' …' if n > 10 else ''}")


# --- ranges, shares, schema ----------------------------------------------------------------------------------


def range_gates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range, outward-rounded bounds, negative share and coverage of each column."""
    long = S.unpivot(df, [], columns)
    v = F.col("value")
    return long.groupBy("metric").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.floor(F.min(v)).alias("bound_low"), F.ceil(F.max(v)).alias("bound_high"),
        (S.div(F.count_if(v < 0), F.count(v)) * 100).alias("negative_pct"), (F.count(v) / F.count("*") * 100).alias("coverage_pct"),
    )


def percentile_gates(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """1st, 50th and 99th percentile of each column, and whether the outer two lie within its bounds."""
    long = S.unpivot(df, [], list(bounds))
    q = exact_quantiles(long, ["metric"], "value", {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    low, high = (F.element_at(F.map_from_arrays(F.array(*map(F.lit, bounds)), F.array(*[F.lit(float(b[i])) for b in bounds.values()])), F.col("metric")) for i in (0, 1))
    return q.select("metric", "p01", "p50", "p99", ((F.col("p01") >= low) & (F.col("p99") <= high)).alias("ok"))


def gap_extent(df: DataFrame, column: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Days on which any series misses a column, and series that miss it on any day."""
    miss = df.where(F.col(column).isNull())
    d = miss.select("date").distinct().agg(F.count("*").alias("n_gap_days"))
    s = miss.select(*keys).distinct().agg(F.count("*").alias("n_gap_series"))
    return d.join(F.broadcast(s))


def code_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each code, with the share total carried for checking."""
    n = df.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return n.withColumn("pct", F.col("n") / F.sum("n").over(w) * 100)


def split_total(parts: DataFrame, whole: DataFrame, by: Sequence[str], count: str = "n") -> DataFrame:
    """Whether the parts of each group sum to its total."""
    p = parts.groupBy(*by).agg(F.sum(count).alias("parts"))
    return p.join(whole.select(*by, F.col(count).alias("total")), list(by), "full_outer").withColumn(
        "ok", F.coalesce(F.col("parts") == F.col("total"), F.lit(False))
    )


def column_metadata(df: DataFrame, required: Sequence[str] = ("units", "long_name", "source")) -> DataFrame:
    """Type, required metadata and what is missing for every column."""
    rows = [
        (f.name, f.dataType.simpleString(), *[str(f.metadata.get(r, "")) for r in required], ",".join(r for r in required if not f.metadata.get(r)))
        for f in df.schema
    ]
    ddl = "column string, type string, " + ", ".join(f"{r} string" for r in required) + ", missing string"
    return df.sparkSession.createDataFrame(rows, ddl)


def column_audit(df: DataFrame, required: Sequence[str] = ("units", "long_name", "source")) -> DataFrame:
    """``column_metadata`` with the rows and nulls of every column, counted in one pass; ``ok`` if nothing is missing."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("n_values")) for i, c in enumerate(df.columns)])
    held = counts.select(F.col("_n").alias("n_rows"), F.explode(pairs).alias("e")).select("n_rows", "e.*")
    both = column_metadata(df, required).join(held, "column")
    return both.withColumn("n_null", F.col("n_rows") - F.col("n_values")).drop("n_values").withColumn("ok", F.col("missing") == "")


def with_metadata(df: DataFrame, meta: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Attach units, long names and sources to columns."""
    return df.select(*[F.col(c).alias(c, metadata=dict(meta[c])) if c in meta else F.col(c) for c in df.columns])


def screen_overlap(flags: DataFrame, screens: Mapping[str, Column], violation: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Violations, those each screen catches and those none catches."""
    any_screen = F.lit(False)
    for c in screens.values():
        any_screen = any_screen | F.coalesce(c, F.lit(False))
    v = F.coalesce(violation, F.lit(False))
    return flags.agg(
        F.count_if(v).alias("n_violations"), *[F.count_if(v & F.coalesce(c, F.lit(False))).alias(f"n_{n}") for n, c in screens.items()],
        F.count_if(v & ~any_screen).alias("n_uncaught"),
    )


def grades_of_flagged(flagged: DataFrame, grades: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Grade mix of flagged series."""
    g = grades.join(flagged.select(*keys).distinct(), list(keys), "left_semi")
    return g.groupBy("overall_grade").agg(F.count("*").alias("n"))


def uncaught(violations: DataFrame, screened: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Violating series that no screen lists."""
    return violations.join(screened.select(*keys).distinct(), list(keys), "left_anti")


# --- manifest ----------------------------------------------------------------------------------------------------


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, status)``: ok, changed, missing or unlisted, exhaustive in both directions.

    Both inputs are ``(path, digest)``.
    """
    j = files.select("path", F.col("digest").alias("_f")).join(manifest.select("path", F.col("digest").alias("_m")), "path", "full_outer")
    f, m = F.col("_f"), F.col("_m")
    return j.select(
        "path", F.when(f.isNull(), "missing").when(m.isNull(), "unlisted").when(f == m, "ok").otherwise("changed").alias("status")
    )


# --- ids and classes ------------------------------------------------------------------------------------------------


def find_id_column(columns: Sequence[str], aliases: Sequence[str] = ID_ALIASES) -> str:
    """The one column whose normalised name is a known alias; none or several is an error."""
    norm = lambda c: re.sub(r"[^a-z0-9]", "", c.lower())
    known = {norm(a) for a in aliases}
    hits = [c for c in columns if norm(c) in known]
    if len(hits) != 1:
        raise ValueError(f"expected one id column, found {hits or 'none'} in {list(columns)}")
    return hits[0]


def with_series_id(df: DataFrame, aliases: Sequence[str] = ID_ALIASES) -> DataFrame:
    c = find_id_column(df.columns, aliases)
    return df.withColumnRenamed(c, "series_id").withColumn("series_id", F.col("series_id").cast("string"))


def equal_width_classes(df: DataFrame, value: str, n_bins: int = 6) -> DataFrame:
    """``(bin, low, high, n)``: equal-width classes between minimum and maximum, outer ones open."""
    v = F.col(value).cast("double")
    good = df.select(F.when(~v.isin(float("nan"), float("inf"), float("-inf")), v).alias("v")).where("v IS NOT NULL")
    ext = good.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # One row of bounds.
    j = good.join(F.broadcast(ext))
    step = (F.col("hi") - F.col("lo")) / n_bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(n_bins - 1)))
    n = j.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ext.select(F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"), "lo", step.alias("step"))
    return grid.join(n, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
