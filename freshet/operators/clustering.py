"""Clustering of series by attributes or regime, and partition comparison.

Exact agglomerative and hierarchical-density methods need all pairs, so they are re-aimed:
regimes come from bisecting k-means, end-members from dense micro-clusters linked by distance.
The results are analogues, not copies, of those methods.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import stats as S
from ..functions.quantiles import exact_quantiles, mid_ranks

ID = "series_id"


def as_vectors(df: DataFrame, columns: Sequence[str], id_col: str = ID) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df).select(id_col, "features")


# --- preparation ---------------------------------------------------------------------------------------


def impute_medians(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (ID,)) -> DataFrame:
    """Null cells take the exact column median."""
    long = S.unpivot(df, ids, columns)
    med = exact_quantiles(long, ["metric"], "value", {"med": 0.5})
    wide = med.agg(*[F.max(F.when(F.col("metric") == c, F.col("med"))).alias(f"_m_{c}") for c in columns])
    # One row of medians.
    j = df.join(F.broadcast(wide))
    return j.select(*ids, *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in columns])


def normal_scores(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (ID,)) -> DataFrame:
    """Columns mapped to normal quantiles of their mid-ranks."""
    long = S.unpivot(df, ids, columns)
    n = long.groupBy("metric").agg(F.count("value").alias("_n"))
    r = mid_ranks(long, ["metric"], "value", "_r").join(F.broadcast(n), "metric")
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), (F.col("_r") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))))
    z = r.select(*ids, "metric", D.normal_quantile(p).alias("z"))
    return z.groupBy(*ids).agg(*[F.max(F.when(F.col("metric") == c, F.col("z"))).alias(c) for c in columns])


def min_max(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (ID,)) -> DataFrame:
    """Columns scaled to 0..1; constant columns become 0."""
    ext = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    j = df.join(F.broadcast(ext))
    return j.select(*ids, *[
        F.coalesce(S.div(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)).alias(c) for c in columns
    ])


def principal_components(vectors: DataFrame, share: float = 0.9, id_col: str = ID) -> tuple[DataFrame, list[float]]:
    """Leading components that explain ``share`` of the variance, and their shares."""
    width = vectors.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    model = PCA(k=width, inputCol="features", outputCol="pc").fit(vectors)
    explained = [float(v) for v in model.explainedVariance]
    keep, total = 0, 0.0
    while keep < width and total < share:
        total += explained[keep]
        keep += 1
    cut_to = array_to_vector(F.slice(vector_to_array("pc"), 1, keep))
    return model.transform(vectors).select(id_col, cut_to.alias("features")), explained[:keep]


# --- silhouettes -----------------------------------------------------------------------------------------


def silhouettes(labelled: DataFrame, label: str = "cluster", id_col: str = ID) -> DataFrame:
    """Silhouette of each point in squared Euclidean distance.

    The mean squared distance to a cluster follows from its size, mean and mean squared norm, so
    each point meets one row per cluster and no pair of points is formed.
    """
    v = labelled.select(id_col, F.col(label).alias("_c"), vector_to_array("features").alias("x"))
    v = v.withColumn("xx", F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    dims = v.select("_c", "xx", F.posexplode("x").alias("d", "e"))
    mean = dims.groupBy("_c", "d").agg(F.avg("e").alias("m")).groupBy("_c").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mu")
    )
    size = v.groupBy("_c").agg(F.count("*").alias("n"), F.avg("xx").alias("yy"))
    stats = mean.join(size, "_c").select(F.col("_c").alias("k"), "mu", "n", "yy")
    # One row per cluster (the number of clusters is a parameter), so broadcasting is bounded.
    j = v.join(F.broadcast(stats))
    dot = F.aggregate(F.zip_with("x", "mu", lambda a, b: a * b), F.lit(0.0), lambda a, e: a + e)
    j = j.select(id_col, "_c", "k", "n", F.greatest(F.col("xx") - 2 * dot + F.col("yy"), F.lit(0.0)).alias("d"))
    own = F.col("_c") == F.col("k")
    per = j.groupBy(id_col, "_c").agg(
        F.max(F.when(own, S.div(F.col("d") * F.col("n"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"),
        F.max(F.when(own, F.col("n"))).alias("n"),
    )
    s = F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(S.div(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select(id_col, F.col("_c").alias(label), s.alias("silhouette"))


def silhouette_sweep(vectors: DataFrame, k_min: int = 2, k_max: int = 20, seed: int = 0, id_col: str = ID) -> DataFrame:
    """k-means for each k with mean and minimum silhouette; the loop is over a parameter.

    Each k is summed up to its one row before the next, so no plan holds more than one k.
    """
    rows = []
    for k in range(k_min, k_max + 1):
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
        s = silhouettes(model.transform(vectors), id_col=id_col).agg(F.avg("silhouette"), F.min("silhouette")).first()
        rows.append((k, s[0], s[1]))
    return vectors.sparkSession.createDataFrame(rows, "k int, mean_silhouette double, min_silhouette double")


# --- regimes and end-members ---------------------------------------------------------------------------------


def relabel_by_size(labelled: DataFrame, label: str = "cluster", new: str = "regime") -> DataFrame:
    """Number clusters 1..K by descending size (ties to the smaller old label)."""
    n = labelled.groupBy(label).agg(F.count("*").alias("_n"))
    rank = n.select(label, F.row_number().over(Window.partitionBy().orderBy(F.desc("_n"), label)).alias(new))
    return labelled.join(F.broadcast(rank), label)


def regimes(vectors: DataFrame, k: int = 15, seed: int = 0) -> DataFrame:
    """Hierarchical (bisecting) split into ``k`` regimes numbered by size."""
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    return relabel_by_size(model.transform(vectors))


def end_members(vectors: DataFrame, min_size: int = 40, micro: int = 60, reach: float = 1.5, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Dense groups with noise: ``(id, end_member, membership)``, -1 for noise.

    Points gather in ``micro`` small clusters; clusters with too few points for their share are
    noise, and the rest join when their centres lie within ``reach`` times the typical spacing.
    The centre graph has at most ``micro`` nodes, whatever the number of points.
    """
    model = KMeans(k=micro, seed=seed, featuresCol="features", predictionCol="cell").fit(vectors)
    pts = model.transform(vectors)
    spark = vectors.sparkSession
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    n = len(centres)
    near = [min((math.dist(a, b) for j, b in enumerate(centres) if j != i), default=0.0) for i, a in enumerate(centres)]
    limit = reach * sorted(near)[n // 2] if near else 0.0
    # Cell sizes and centres: at most ``micro`` rows, a parameter, whatever the number of points.
    sizes = {r["cell"]: r["c"] for r in pts.groupBy("cell").agg(F.count("*").alias("c")).collect()}
    dense = [i for i, c in sorted(sizes.items()) if c >= sum(sizes.values()) / (4.0 * micro)]
    group = {i: i for i in dense}
    for i in dense:
        for j in dense:
            if group[i] != group[j] and math.dist(centres[i], centres[j]) <= limit:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {c: new if g == old else g for c, g in group.items()}
    mass = {g: sum(sizes[c] for c in dense if group[c] == g) for g in set(group.values())}
    order = sorted((g for g, m in mass.items() if m >= min_size), key=lambda g: (-mass[g], g))
    lookup = spark.createDataFrame(
        [(c, order.index(g)) for c, g in group.items() if g in order] or [(-1, -1)], "cell int, end_member int"
    )
    table = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>")
    out = pts.join(F.broadcast(lookup), "cell", "left").join(F.broadcast(table), "cell")
    d2 = F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, e: a + e)
    scale = limit * limit if limit > 0 else 1.0
    return out.select(id_col, F.coalesce("end_member", F.lit(-1)).alias("end_member"),
                      F.when(F.col("end_member").isNull(), 0.0).otherwise(F.exp(-d2 / scale)).alias("membership"))


def stability(vectors: DataFrame, labels: DataFrame, share: float = 0.85, rounds: int = 20, seed: int = 42, id_col: str = ID, **kw) -> DataFrame:
    """Adjusted Rand index between the labelling and those of hashed subsamples; each round is summed up to its row before the next."""
    rows = []
    for i in range(rounds):
        pick = F.pmod(F.xxhash64(id_col, F.lit(seed + i)), F.lit(10_000)) < int(share * 10_000)
        sub = end_members(vectors.where(pick), id_col=id_col, **kw).select(id_col, F.col("end_member").alias("b"))
        both = labels.select(id_col, F.col("end_member").alias("a")).join(sub, id_col).where("a >= 0 AND b >= 0")
        r = adjusted_rand(both, "a", "b").first()
        rows.append((i, r["ari"], r["n"]))
    return vectors.sparkSession.createDataFrame(rows, "round int, ari double, n long")


def profiles(df: DataFrame, columns: Sequence[str], label: str = "cluster", membership: str | None = None) -> DataFrame:
    """Per cluster: size, mean z-score and exact median of each column, mean membership."""
    ext = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    j = df.join(F.broadcast(ext))
    aggs = [F.count("*").alias("n")]
    if membership:
        aggs.append(F.avg(membership).alias("mean_membership"))
    z = [F.avg(S.div(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))).alias(f"z_{c}") for c in columns]
    out = j.groupBy(label).agg(*aggs, *z)
    long = S.unpivot(df, [label], columns).where("value IS NOT NULL")
    med = exact_quantiles(long, [label, "metric"], "value", {"med": 0.5})
    wide = med.groupBy(label).agg(*[F.max(F.when(F.col("metric") == c, F.col("med"))).alias(f"median_{c}") for c in columns])
    return out.join(wide, label)


def centroids_long(df: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """``(cluster, feature, norm, raw)``: mean of the min-max scaled and of the raw columns."""
    scaled = min_max(df, columns, [label, ID])
    norm = S.unpivot(scaled, [label], columns).groupBy(label, "metric").agg(F.avg("value").alias("norm"))
    raw = S.unpivot(df, [label], columns).groupBy(label, "metric").agg(F.avg("value").alias("raw"))
    return norm.join(raw, [label, "metric"]).select(F.col(label).alias("cluster"), F.col("metric").alias("feature"), "norm", "raw")


# --- comparing partitions ----------------------------------------------------------------------------------------


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency counts."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").cast("double").alias("c"))
    cell = n.agg(pairs(F.col("c")).alias("ij"), F.sum("c").alias("n"))
    rows = n.groupBy("_a").agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("i"))
    cols = n.groupBy("_b").agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("j"))
    # Three single-row tables.
    t = cell.join(F.broadcast(rows)).join(F.broadcast(cols))
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = S.div(F.col("i") * F.col("j"), total)
    best = (F.col("i") + F.col("j")) / 2
    return t.select(F.coalesce(S.div(F.col("ij") - expected, best - expected), F.lit(1.0)).alias("ari"), F.col("n").cast("long").alias("n"))


def modal_labels(df: DataFrame, a: str, b: str) -> DataFrame:
    """Most frequent ``b`` within each ``a`` (smallest label on ties) and its share."""
    n = df.groupBy(a, b).agg(F.count("*").alias("c"))
    return n.groupBy(a).agg(
        F.min_by(b, F.struct(-F.col("c"), F.col(b))).alias("modal"), F.max("c").alias("n_modal"), F.sum("c").alias("n")
    )


def concordance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows that carry the modal label of their group, with the Rand index."""
    m = modal_labels(df, a, b).agg((F.sum("n_modal") / F.sum("n")).alias("concordant"), F.count("*").alias("n_groups"))
    return m.join(F.broadcast(adjusted_rand(df, a, b)))


def granularity_sweep(vectors: DataFrame, regime: DataFrame, sizes: Sequence[int], id_col: str = ID, **kw) -> DataFrame:
    """Number of end-members and Rand index against regimes for several minimum sizes."""
    out = None
    for s in sizes:
        e = end_members(vectors, min_size=s, id_col=id_col, **kw).where("end_member >= 0").join(regime.select(id_col, "regime"), id_col)
        r = adjusted_rand(e, "regime", "end_member").select(F.lit(s).alias("min_size"), "ari", F.col("n").alias("n_both"))
        k = e.agg(F.count_distinct("end_member").alias("n_end_members"))
        r = r.join(F.broadcast(k))
        out = r if out is None else out.unionByName(r)
    return out
