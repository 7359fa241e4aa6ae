"""Exact quantiles, mid-ranks and rank correlation for groups of any size.

``percentile`` keeps every distinct value of a group in one task, which is fine for the days of
one series but not for a network of series.  Here a group is cut into value buckets at
approximate quantiles (a mergeable sketch, used for balance only), ranks inside a bucket are
exact, and bucket offsets come from a small table of counts.  The result is exact and no task
holds more than one bucket; equal values are collapsed first, so ties cannot make one hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import salted_join
from .stats import corr

BUCKETS = 64


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS, weight: str | None = None
) -> DataFrame:
    """``keys, value, lo, hi, n``: first and last rank of each distinct value, and the group size.

    ``weight`` names an integer column that counts a row more than once.
    """
    size = F.sum(weight) if weight else F.count("*")
    k = list(keys)
    cuts = [i / buckets for i in range(1, buckets)]
    counts = df.where(F.col(value).isNotNull()).groupBy(*k, value).agg(size.alias("_c"))
    bounds = counts.groupBy(*k).agg(F.percentile_approx(value, cuts, 1000).alias("_b"))
    v = F.col(value)
    tagged = salted_join(counts, bounds, k, [value]).select(
        *k, value, "_c", F.size(F.filter("_b", lambda b: b < v)).alias("_bucket")
    )
    sizes = tagged.groupBy(*k, "_bucket").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*k)
    offsets = sizes.select(
        *k, "_bucket",
        (F.sum("_s").over(w.orderBy("_bucket")) - F.col("_s")).alias("_off"),
        F.sum("_s").over(w).alias("n"),
    )
    inside = Window.partitionBy(*k, "_bucket").orderBy(value)
    return tagged.join(offsets, [*k, "_bucket"]).select(
        *k, value,
        (F.col("_off") + F.sum("_c").over(inside) - F.col("_c") + 1).alias("lo"),
        (F.col("_off") + F.sum("_c").over(inside)).alias("hi"),
        "n",
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of each group, one column per entry of ``probs``."""
    r = value_ranks(df, keys, value)
    picks, outs = [], []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        for end, rank in (("a", F.floor(h) + 1), ("b", F.ceil(h) + 1)):
            picks.append(F.max(F.when((F.col("lo") <= rank) & (rank <= F.col("hi")), F.col(value))).alias(f"_{name}_{end}"))
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        frac = (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
        outs.append((a + (b - a) * frac).alias(name))
    picked = r.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    return picked.select(*keys, *outs)


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", weight: str | None = None) -> DataFrame:
    """Average rank (ties share the mean rank) attached to every non-null row."""
    return df.join(rank_lookup(df, keys, value, name, weight), [*keys, value])


def rank_lookup(df: DataFrame, keys: Sequence[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """Average rank of each distinct value."""
    return value_ranks(df, keys, value, weight=weight).select(*keys, value, ((F.col("lo") + F.col("hi")) / 2).alias(name))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation over rows where both columns are present, for groups of any size."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    # Both rankings start from the pairs, so the plan holds them side by side instead of nested.
    rx, ry = rank_lookup(both, keys, x, "_rx"), rank_lookup(both, keys, y, "_ry")
    # A value shared by many rows is spread by the other column of the pair.
    ranked = salted_join(salted_join(both, rx, [*keys, x], [y]), ry, [*keys, y], [x])
    return ranked.groupBy(*keys).agg(corr("_rx", "_ry").alias("rho"), F.count("*").alias("n_pairs"))


def spearman_daily(df: DataFrame, keys: Sequence[str], x: str, y: str, extra=()) -> DataFrame:
    """Rank correlation within groups that the calendar bounds: windows on one exchange."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*keys)

    def mid(c: str):
        o = w.orderBy(c)
        same = Window.partitionBy(*keys, c)
        return F.rank().over(o) + (F.count("*").over(same) - 1) / 2

    return both.select("*", mid(x).alias("_rx"), mid(y).alias("_ry")).groupBy(*keys).agg(
        corr("_rx", "_ry").alias("rho"), F.count("*").alias("n_pairs"), *extra
    )


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, rank: str = "rank") -> DataFrame:
    """Attach the value at given ranks: ``wanted`` holds ``keys`` and a 1-based rank column.

    Ranks and rank intervals meet on coarse rank buckets, then exactly inside them.
    """
    k = list(keys)
    r = value_ranks(df, keys, value)
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / 256))
    spans = r.select(*k, value, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))).alias("_rb"))
    sizes = r.groupBy(*k).agg(F.max("n").alias("_n"))
    asked = wanted.join(sizes, k).withColumn("_rb", F.floor(F.col(rank) / F.greatest(F.lit(1), F.ceil(F.col("_n") / 256))))
    hit = asked.join(spans, [*k, "_rb"]).where((F.col(rank) >= F.col("lo")) & (F.col(rank) <= F.col("hi")))
    return hit.drop("_rb", "_n", "lo", "hi")
