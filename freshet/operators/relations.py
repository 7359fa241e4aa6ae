"""Relations between attributes and metrics: bootstrap intervals, binned medians, subset summaries."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.quantiles import exact_quantiles, ranked_values, spearman, spearman_daily
from .bootstrap import N_BOOT, SEED, boot_spearman_ci

cloudpickle.register_pickle_by_value(sys.modules[__name__])



KEY = ("series_id",)
OPEN_WATER = (5, 6, 7, 8, 9, 10)


def finite(c: Column) -> Column:
    return F.when(~c.isin(float("nan"), float("inf"), float("-inf")), c)


# --- bootstrap ------------------------------------------------------------------------------------------


def boot_median_ci(df: DataFrame, keys: Sequence[str], value: str, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """Median with a 95 % percentile-bootstrap interval.

    The middle order statistics of a resample of size n are order statistics of n uniform draws
    over the ranks, so each replicate needs two Beta-distributed numbers instead of n draws.  The
    replicates ask for values by rank, and no group is gathered.
    """
    k = list(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    sizes = df.where(F.col(value).isNotNull()).groupBy(*k).agg(F.count("*").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        label = "|".join(str(pdf[c].iloc[0]) for c in k)
        rng = np.random.default_rng([seed, zlib.crc32(label.encode())])
        a, b = (n + 1) // 2, n // 2 + 1
        low = rng.gamma(a, size=n_boot)
        mid = rng.gamma(1.0, size=n_boot) if b > a else np.zeros(n_boot)
        high = rng.gamma(n - b + 1, size=n_boot)
        total = low + mid + high
        ranks = [np.clip(np.ceil(n * u / total), 1, n).astype("int64") for u in (low, low + mid)]
        ids = {c: np.repeat(pdf[c].iloc[0], 2 * n_boot) for c in k}
        return pd.DataFrame({**ids, "rep": np.tile(np.arange(n_boot), 2), "rank": np.concatenate(ranks)})

    ddl = ", ".join(f"{c} {types[c]}" for c in k) + ", rep int, rank bigint"
    draws = sizes.groupBy(*k).applyInPandas(draw, ddl)
    reps = ranked_values(df, k, value, draws).groupBy(*k, "rep").agg(F.avg(value).alias("med"))
    # A fixed number of replicates per group, so the plain percentile is bounded.
    ci = reps.groupBy(*k).agg(S.quantile("med", 0.025).alias("ci_lo"), S.quantile("med", 0.975).alias("ci_hi"))
    return sizes.join(exact_quantiles(df, k, value, {"median": 0.5}), k).join(ci, k)


# --- bins ------------------------------------------------------------------------------------------------


def subset_spearman(df: DataFrame, subsets: dict[str, Column], x: str, y: str) -> DataFrame:
    """``subset, rho, n_pairs``: rank correlation inside each of some overlapping subsets."""
    tags = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]), lambda t: t.isNotNull()))
    return spearman(df.select(tags.alias("subset"), x, y), ["subset"], x, y)


def lowest_share(df: DataFrame, by: str, share: float = 0.2) -> DataFrame:
    """Rows whose value is at or below the given quantile of all values."""
    cut = exact_quantiles(df.withColumn("_all", F.lit("all")), ["_all"], by, {"cut": share}).select("cut")
    # ``cut`` is a single row.
    return df.join(F.broadcast(cut)).where(F.col(by) <= F.col("cut")).drop("cut")


def window_medians(df: DataFrame, x: str, y: str, windows: dict[str, tuple[float, float]]) -> DataFrame:
    """``window, n, median``: median of y over rows whose x lies in each window, both ends included."""
    inside = {n: F.col(x).between(a, b) for n, (a, b) in windows.items()}
    tags = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in inside.items()]), lambda t: t.isNotNull()))
    rows = df.select(tags.alias("window"), F.col(y).cast("double").alias("y")).where("y IS NOT NULL")
    return rows.groupBy("window").agg(F.count("*").alias("n")).join(exact_quantiles(rows, ["window"], "y", {"median": 0.5}), "window")


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin, the lowest edge included; null outside."""
    out = F.when(x.isNull() | (x < edges[0]) | (x > edges[-1]), F.lit(None).cast("int"))
    for i, hi in enumerate(edges[1:]):
        out = out.when(x <= hi, i)
    return out


def binned_median(df: DataFrame, x: str, y: str, edges: Sequence[float]) -> DataFrame:
    """Middle, median, quartiles and count of y per bin of x (clipped to the edges), and rows of the bin without y; empty bins stay."""
    spark = df.sparkSession
    clipped = F.least(F.greatest(finite(F.col(x).cast("double")), F.lit(float(edges[0]))), F.lit(float(edges[-1])))
    rows = df.select(right_closed_bin(clipped, edges).alias("bin"), finite(F.col(y).cast("double")).alias("y")).where("bin IS NOT NULL")
    d = rows.where("y IS NOT NULL")
    grid = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    mids = F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])]), F.col("bin") + 1)
    n = rows.groupBy("bin").agg(F.count("y").alias("n"), F.count_if(F.col("y").isNull()).alias("n_missing"))
    q = exact_quantiles(d, ["bin"], "y", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return grid.withColumn("center", mids).join(n, "bin", "left").join(q, "bin", "left").fillna(0, ["n", "n_missing"])


def shape_bands(df: DataFrame, x: str, y: str, bands: Mapping[str, Column]) -> DataFrame:
    """Median and count of y in named ranges of x, as one row (for example baseline, peak, high)."""
    name = F.lit(None).cast("string")
    for b, cond in bands.items():
        name = F.when(cond, b).otherwise(name)
    d = df.select(name.alias("band"), F.col(y).alias("y")).where("band IS NOT NULL AND y IS NOT NULL")
    n = d.groupBy("band").agg(F.count("*").alias("n")).join(exact_quantiles(d, ["band"], "y", {"med": 0.5}), "band")
    return n.agg(
        *[F.max(F.when(F.col("band") == b, F.col("med"))).alias(f"{b}_med") for b in bands],
        *[F.coalesce(F.max(F.when(F.col("band") == b, F.col("n"))), F.lit(0)).alias(f"{b}_n") for b in bands],
    )


def shape_verdict(shape: DataFrame) -> DataFrame:
    """Hump: the peak band's median above both the baseline and the high band."""
    return shape.withColumn("hump", (F.col("peak_med") > F.col("baseline_med")) & (F.col("peak_med") > F.col("high_med")))


def sign_reversal(df: DataFrame, split: Column, x: str, y: str) -> DataFrame:
    """Rank correlation on both sides of a split and whether its sign turns."""
    side = F.when(split, "above").otherwise("below")
    r = spearman(df.withColumn("side", side), ["side"], x, y)
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("rho")))
    out = r.agg(pick("above").alias("rho_above"), pick("below").alias("rho_below"))
    return out.withColumn("reversed", F.col("rho_above") * F.col("rho_below") < 0)


# --- stage against flow --------------------------------------------------------------------------------------


def stage_consistency(
    df: DataFrame, keys: Sequence[str] = KEY, min_days: int = 365, weak: float = 0.5, months: Sequence[int] = OPEN_WATER
) -> DataFrame:
    """Rank correlation of flow and stage on jointly observed days, all year and in open water.

    Input ``(keys, date, value, stage)``.  The screen is -1 not assessed, 0 consistent, 1 weak.
    """
    k = list(keys)
    both = df.where("value IS NOT NULL AND stage IS NOT NULL").select(*k, "date", "value", "stage")
    varies = [(F.max(c) > F.min(c)).alias(f"_{c}") for c in ("value", "stage")]

    def rho(d: DataFrame, name: str) -> DataFrame:
        r = spearman_daily(d, k, "value", "stage", extra=varies)
        ok = (F.col("n_pairs") >= min_days) & F.col("_value") & F.col("_stage")
        return r.select(*k, F.col("n_pairs").alias(f"n_{name}"), F.when(ok, F.col("rho")).alias(f"rho_{name}"))

    out = rho(both, "all").join(rho(both.where(F.month("date").isin(*months)), "open_water"), k, "left")
    r = F.col("rho_open_water")
    return out.withColumn("screen", F.when(r.isNull(), -1).when(r >= weak, 0).otherwise(1))


def stage_window_sensitivity(df: DataFrame, windows: Mapping[str, Sequence[int]], keys: Sequence[str] = KEY, min_days: int = 365, weak: float = 0.5) -> DataFrame:
    """Number of series with a weak rank correlation under each month window."""
    k = [*keys, "window"]
    tags = F.explode(F.filter(F.array(*[F.when(F.month("date").isin(*m), F.lit(n)) for n, m in windows.items()]), lambda w: w.isNotNull()))
    both = df.where("value IS NOT NULL AND stage IS NOT NULL").select(*keys, "value", "stage", tags.alias("window"))
    varies = [(F.max(c) > F.min(c)).alias(f"_{c}") for c in ("value", "stage")]
    r = spearman_daily(both, k, "value", "stage", extra=varies)
    weak_one = (F.col("n_pairs") >= min_days) & F.col("_value") & F.col("_stage") & (F.col("rho") < weak)
    return r.groupBy("window").agg(F.count_if(weak_one).alias("n_weak"))


# --- subsets ----------------------------------------------------------------------------------------------------


def subset_summary(df: DataFrame, subsets: Mapping[str, Column], metrics: Sequence[str], ids: Sequence[str] = KEY) -> DataFrame:
    """n, mean, median, 10 % / 90 % quantiles, minimum and maximum of metrics in overlapping subsets."""
    tags = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]), lambda t: t.isNotNull()))
    long = S.unpivot(df.select("*", tags.alias("subset")), [*ids, "subset"], metrics).where("value IS NOT NULL")
    k = ["subset", "metric"]
    base = long.groupBy(*k).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(exact_quantiles(long, k, "value", {"p10": 0.1, "median": 0.5, "p90": 0.9}), k)


def subset_flow(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Ordered funnel of subset counts from one pass over the table."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in steps.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("subset"), F.col(n).alias("n")) for i, n in enumerate(steps, 1)]))
    return counts.select(rows.alias("r")).select("r.step", "r.subset", "r.n")


def strict_subset(daily: DataFrame, metrics: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY, min_share: float = 0.7, min_values: int = 5) -> DataFrame:
    """Series whose four seasons are observed well enough and whose period metrics are complete."""
    from ..functions import calendar as C

    s = C.season(F.col("date"))
    seen = F.col("value").isNotNull().cast("double")
    seasons = daily.groupBy(*keys).agg(*[F.avg(F.when(s == n, seen)).alias(n) for n in C.SEASONS])
    complete = metrics.groupBy(*keys).agg(*[F.count(c).alias(f"n_{c}") for c in columns])
    j = seasons.join(complete, list(keys), "left")
    ok_season = F.least(*[F.coalesce(n, F.lit(0.0)) for n in C.SEASONS]) >= min_share
    ok_metric = F.least(*[F.coalesce(f"n_{c}", F.lit(0)) for c in columns], F.lit(10**9)) >= min_values
    return j.select("*", ok_season.alias("season_complete"), ok_metric.alias("metric_complete"), (ok_season & ok_metric).alias("strict"))


def share_table(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value of a small column."""
    n = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def id_audit(sources: Mapping[str, DataFrame], id_col: str = "series_id", long_length: int = 7) -> DataFrame:
    """Rows, distinct ids, duplicates and id lengths per source."""
    out = None
    for name, d in sources.items():
        p = d.select(F.lit(name).alias("source"), F.col(id_col).cast("string").alias("id"))
        out = p if out is None else out.unionByName(p)
    per = out.groupBy("source", "id").agg(F.count("*").alias("c"))
    n = F.length("id")
    return per.groupBy("source").agg(
        F.sum("c").alias("n"), F.count("*").alias("n_unique"), (F.sum("c") - F.count("*")).alias("n_duplicate_rows"),
        F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(F.when(n >= long_length, F.col("c")).otherwise(0)).alias("n_long"),
    )


def id_membership(sources: Mapping[str, DataFrame], id_col: str = "series_id", long_length: int = 7) -> DataFrame:
    """Which sources hold each long id."""
    out = None
    for name, d in sources.items():
        p = d.select(F.col(id_col).cast("string").alias("id"), F.lit(name).alias("source"))
        out = p if out is None else out.unionByName(p)
    return out.where(F.length("id") >= long_length).groupBy("id").agg(
        *[F.max((F.col("source") == n).cast("int")).alias(f"in_{n}") for n in sources]
    )
