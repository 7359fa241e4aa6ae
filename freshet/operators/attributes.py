"""Catchment attributes: overlap means, feature selection and rule-based cluster labels."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .overlay import KM2, covered, overlaps

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("series_id",)
# Smallest overlap that counts (km2) and features always kept.
MIN_OVERLAP_KM2 = 5.0
ALWAYS_KEPT = (
    "for_pc_sse", "crp_pc_sse", "inu_pc_ult", "ire_pc_sse", "lka_pc_use", "prm_pc_sse", "pst_pc_sse", "cly_pc_sav",
    "slt_pc_sav", "snd_pc_sav", "kar_pc_sse", "urb_pc_sse", "gwt_cm_sav", "lkv_mc_usu", "rev_mc_usu", "sgr_dk_sav",
    "slp_dg_sav", "ws_area", "ele_mt_sav",
)
# Label priority and label of standout features.
LABELS = {
    "prm_pc_use": (1, "Permafrost"),
    "snw_pc_uyr": (2, "Snow-dominated"),
    "ele_mt_uav": (2, "Highland"),
    "lka_pc_use": (2, "Lake-regulated"),
    "kar_pc_use": (2, "Karst"),
    "gla_pc_use": (3, "Glacial"),
    "pre_mm_uyr": (3, "Humid"),
    "aet_mm_uyr": (3, "High-ET"),
    "gwt_cm_sav": (3, "Deep-GW"),
    "for_pc_use": (4, "Forested"),
    "crp_pc_use": (4, "Cropland"),
    "pst_pc_use": (4, "Pasture"),
    "ire_pc_use": (4, "Irrigated"),
    "urb_pc_use": (4, "Urban"),
    "cly_pc_uav": (5, "Clay-rich"),
    "snd_pc_uav": (5, "Sandy"),
}


def area_weighted(
    overlaps: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY, min_overlap: float = 0.0,
    scale: Mapping[str, float] | None = None,
) -> DataFrame:
    """Overlap-weighted mean of each column over the polygons that carry a value.

    ``overlaps`` is ``(keys, overlap_km2, columns…)``; weights are normalised per column, so
    partial coverage does not scale the result.  ``scale`` divides stored units.
    """
    w = F.col("overlap_km2")
    scale = scale or {}
    means = [
        (S.div(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))) / float(scale.get(c, 1.0))).alias(c) for c in columns
    ]
    return overlaps.where(w >= min_overlap).groupBy(*keys).agg(*means, F.sum(w).alias("overlap_km2"), F.count("*").alias("n_polygons"))


def extract_attributes(
    catchments: DataFrame, overlaps: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY,
    scale: Mapping[str, float] | None = None, min_overlap: float = MIN_OVERLAP_KM2,
) -> DataFrame:
    """Attribute row per catchment with covered fraction and polygon count; no overlap is an error."""
    k = list(keys)
    a = area_weighted(overlaps, columns, keys, min_overlap, scale)
    j = catchments.select(*k, "area_km2").join(a, k, "left")
    msg = F.concat(F.lit("no attribute polygon overlaps "), F.col(k[0]).cast("string"))
    checked = F.when(F.col("n_polygons").isNull(), F.raise_error(msg).cast("long")).otherwise(F.col("n_polygons"))
    return j.select(*k, *columns, S.div(F.col("overlap_km2"), F.col("area_km2")).alias("area_fraction_used"), checked.alias("n_polygons"))


def extract_from_layer(
    catchments: DataFrame, polygons: DataFrame, attributes: DataFrame, columns: Sequence[str], scale: Mapping[str, float] | None = None,
    min_overlap: float = MIN_OVERLAP_KM2,
) -> DataFrame:
    """Attribute row per catchment from a layer of polygons: overlaps, bounded weights, means, covered fraction.

    ``catchments`` and ``polygons`` are vertex tables; ``attributes`` is ``(b_id, columns...)`` by polygon.  Catchments
    without a large enough overlap are left out.
    """
    areas = covered(catchments).groupBy(F.col("poly_id").alias("series_id")).agg((F.sum("area") * float(KM2)).alias("area_km2"))
    met = overlaps(catchments, polygons).where(F.col("overlap_km2") >= min_overlap)
    found = met.join(attributes, "b_id").select(F.col("a_id").alias("series_id"), "overlap_km2", *columns)
    inside = areas.join(found.select("series_id").distinct(), "series_id", "left_semi")
    return extract_attributes(inside, found, columns, scale=scale, min_overlap=min_overlap)


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r, n)`` for every column pair over rows where both are present.

    Each task multiplies its batches into pair sums and emits one row per column pair, so the
    shuffle carries columns squared, never rows.
    """
    cols = list(columns)
    centre = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = np.array([float(centre[c] or 0.0) for c in cols])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(cols)
        acc = {m: np.zeros((p, p)) for m in ("n", "sx", "sy", "sxx", "syy", "sxy")}
        for pdf in batches:
            x = pdf[cols].to_numpy(float) - shift
            ok = ~np.isnan(x)
            z, o = np.where(ok, x, 0.0), ok.astype(float)
            acc["n"] += o.T @ o
            acc["sx"] += z.T @ o
            acc["sy"] += o.T @ z
            acc["sxx"] += (z * z).T @ o
            acc["syy"] += o.T @ (z * z)
            acc["sxy"] += z.T @ z
        i, j = np.triu_indices(p, 1)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), **{m: v[i, j] for m, v in acc.items()}})

    part = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    t = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    c = F.col
    cov = c("sxy") - c("sx") * c("sy") / c("n")
    den = F.sqrt(F.greatest((c("sxx") - c("sx") ** 2 / c("n")) * (c("syy") - c("sy") ** 2 / c("n")), F.lit(0.0)))
    names = F.array(*[F.lit(x) for x in cols])
    return t.where("n > 0").select(
        F.element_at(names, c("i") + 1).alias("a"), F.element_at(names, c("j") + 1).alias("b"), S.div(cov, den).alias("r"), c("n").cast("long").alias("n"),
        "i", "j",
    )


def uncorrelated_features(df: DataFrame, columns: Sequence[str], threshold: float = 0.75, min_valid: float = 0.8) -> DataFrame:
    """``(feature, valid_fraction, max_abs_r, keep)`` in column order.

    Class columns and columns with too few non-zero values are out; a column goes when it
    correlates beyond the threshold with an earlier one that passed the first two tests.
    """
    cols = [c for c in columns if "_cl_" not in c]
    share = df.agg(*[F.avg((F.col(c).isNotNull() & (F.col(c) != 0)).cast("double")).alias(c) for c in cols])
    valid = share.unpivot([], cols, "feature", "valid_fraction")
    good = valid.where(F.col("valid_fraction") >= min_valid).select("feature")
    r = pairwise_correlations(df, cols)
    # Feature-sized tables: at most one row per column.
    both = r.join(F.broadcast(good.withColumnRenamed("feature", "a")), "a").join(F.broadcast(good.withColumnRenamed("feature", "b")), "b")
    top = both.groupBy(F.col("b").alias("feature")).agg(F.max(F.abs("r")).alias("max_abs_r"))
    out = valid.join(top, "feature", "left")
    return out.withColumn(
        "keep", (F.col("valid_fraction") >= min_valid) & ~F.coalesce(F.col("max_abs_r") > threshold, F.lit(False))
    )


def combined_features(selected: Sequence[str], available: Sequence[str], always: Sequence[str] = ALWAYS_KEPT) -> list[str]:
    """Sorted union of the always-kept columns that exist and the selected ones."""
    return sorted({c for c in always if c in available} | set(selected))


def combined_feature_table(screened: DataFrame, available: Sequence[str], always: Sequence[str] = ALWAYS_KEPT) -> DataFrame:
    """``feature, fixed, selected`` of the columns that are always kept (where they exist) or pass ``uncorrelated_features``.

    One row per column of the table, so the result is as small as its schema.
    """
    fixed = screened.sparkSession.createDataFrame([(c,) for c in sorted(set(always) & set(available))], "feature string").withColumn("fixed", F.lit(True))
    kept = screened.where("keep").select("feature", F.lit(True).alias("selected"))
    no = F.lit(False)
    return kept.join(fixed, "feature", "full_outer").select("feature", F.coalesce("fixed", no).alias("fixed"), F.coalesce("selected", no).alias("selected"))


def cluster_labels(centroids: DataFrame, high: float = 0.65) -> DataFrame:
    """Up to two standout labels per cluster from long centroids ``(cluster, feature, norm, raw)``.

    Without a standout the label falls back to elevation and precipitation classes.
    """
    c = F.col
    prio, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for f, (p, text) in LABELS.items():
        prio, label = F.when(c("feature") == f, p).otherwise(prio), F.when(c("feature") == f, text).otherwise(label)
    raw = c("raw")
    text = (
        F.when(c("feature") == "ele_mt_uav", F.format_string("%s (%.0fm)", label, raw))
        .when(c("feature") == "pre_mm_uyr", F.format_string("%s (%.0fmm/yr)", label, raw))
        .when(c("feature") == "gwt_cm_sav", F.format_string("%s GW (%.0fcm)", F.when(raw > 200, "Deep").otherwise("Shallow"), raw))
        .when(c("feature").rlike("_pc_(use|uyr|ult)$"), F.format_string("%s (%.1f%%)", label, raw))
        .otherwise(label)
    )
    w = Window.partitionBy("cluster").orderBy("prio", F.desc("norm"))
    hit = centroids.select("*", prio.alias("prio"), text.alias("text")).where((c("norm") > high) & c("prio").isNotNull())
    top = hit.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("cluster").agg(
        F.max(F.when(c("r") == 1, c("text"))).alias("one"), F.max(F.when(c("r") == 2, c("text"))).alias("two")
    )
    base = centroids.groupBy("cluster").agg(
        F.coalesce(F.max(F.when(c("feature") == "ele_mt_uav", raw)), F.lit(0.0)).alias("ev"),
        F.coalesce(F.max(F.when(c("feature") == "pre_mm_uyr", raw)), F.lit(0.0)).alias("pv"),
    )
    high_text = F.when(c("ev") > 1000, "Highland").when(c("ev") > 500, "Upland").otherwise("Lowland")
    wet_text = F.when(c("pv") > 700, "Humid").when(c("pv") < 400, "Semi-arid").otherwise("Moderate")
    fallback = F.format_string("%s (%.0fm) / %s (%.0fmm/yr)", high_text, c("ev"), wet_text, c("pv"))
    return base.join(top, "cluster", "left").select(
        "cluster", F.when(c("one").isNull(), fallback).otherwise(F.concat_ws(" / ", "one", "two")).alias("label")
    )
