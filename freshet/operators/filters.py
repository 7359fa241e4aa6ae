"""Id scope, grade filters, size classes and column selection rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C

KEY = ("series_id",)
# Shortest excluded id, grade scores, area class bounds and labels.
LONG_ID = 7
SCORES = {"A": 5, "B": 4, "C": 3, "D": 2, "F": 1}
SIZE_BOUNDS = (100, 2000, 10000, 50000, 200000)
SIZE_LABELS = (
    "a) < 100 $km^2$",
    "b) 100 $km^2$ - 2 000 $km^2$",
    "c) 2 000 $km^2$ - 10 000 $km^2$",
    "d) 10 000 $km^2$ - 50 000 $km^2$",
    "e) 50 000 $km^2$ - 200 000 $km^2$",
    "f) > 200 000 $km^2$",
)
USABLE, HIGH = ("A", "B", "C"), ("A", "B")


def out_of_scope(id_col: Column, min_length: int = LONG_ID) -> Column:
    return F.length(id_col.cast("string")) >= min_length


def in_scope(df: DataFrame, id_col: str = "series_id", min_length: int = LONG_ID) -> DataFrame:
    return df.where(~out_of_scope(F.col(id_col), min_length))


def scope_summary(df: DataFrame, id_col: str = "series_id", min_length: int = LONG_ID) -> DataFrame:
    out = out_of_scope(F.col(id_col), min_length)
    return df.agg(
        F.count("*").alias("n_total"), F.count_if(~out).alias("n_included"), F.count_if(out).alias("n_excluded")
    )


def size_class(area: Column) -> Column:
    """Six ordered area classes; the second class includes both of its edges."""
    out = F.when(area < SIZE_BOUNDS[0], SIZE_LABELS[0])
    for bound, label in zip(SIZE_BOUNDS[1:], SIZE_LABELS[1:]):
        out = out.when(area <= bound, label)
    return out.otherwise(SIZE_LABELS[-1])


def ids_by_grade(grades: DataFrame, wanted: Sequence[str] | None = None, id_col: str = "series_id") -> DataFrame:
    """Distinct ids of the wanted grades, sorted."""
    g = grades if wanted is None else grades.where(F.col("overall_grade").isin(*wanted))
    return g.select(id_col).distinct().orderBy(id_col)


def at_least_grade(df: DataFrame, min_grade: str = "C", grade: str = "grade") -> DataFrame:
    """Rows whose grade scores at least as high as ``min_grade``; unknown grades score zero."""
    score = F.lit(0)
    for g, s in SCORES.items():
        score = F.when(F.col(grade) == g, s).otherwise(score)
    return df.where(score >= SCORES.get(min_grade, 0))


def drop_low_years(daily: DataFrame, years: DataFrame, bad: Sequence[str] = ("D", "F"), keys: Sequence[str] = KEY) -> DataFrame:
    """Null the values of days in years of a bad grade; the rows stay."""
    k = [*keys, "hydro_year"]
    low = years.where(F.col("grade").isin(*bad)).select(*k, F.lit(True).alias("_low"))
    d = daily.withColumn("hydro_year", C.hydro_year(F.col("date")))
    return d.join(low, k, "left").withColumn("value", F.when(F.col("_low").isNull(), F.col("value"))).drop("_low", "hydro_year")


def keep_grades(daily: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Null the values of days whose grade is not wanted; the rows stay."""
    return daily.withColumn("value", F.when(F.col("grade").isin(*wanted), F.col("value")))


def grade_statistics(grades: DataFrame) -> DataFrame:
    """Count and share of series per grade."""
    n = grades.groupBy(F.col("overall_grade").alias("grade")).agg(F.count("*").alias("n_series"))
    # At most six grades, so the total is a window over six rows.
    return n.withColumn("pct_total", 100 * F.col("n_series") / F.sum("n_series").over(Window.partitionBy()))


# Spatial extent and kind of statistic that make up the suffix of an attribute column.
EXTENTS, STATISTICS = ("u", "s"), ("yr", "lt", "av", "se", "pv")


def attribute_columns(names: DataFrame) -> DataFrame:
    """``base, name``: one column per base name (its first two words), the second variant where there are several.

    ``names`` is ``(position, name)``.  Only names that end in an extent and a statistic count.
    """
    suffix = f"_({'|'.join(EXTENTS)})({'|'.join(STATISTICS)})$"
    known = names.where(F.col("name").rlike(suffix)).withColumn("base", F.substring_index("name", "_", 2))
    order = Window.partitionBy("base").orderBy("position")
    ranked = known.select("base", "name", F.row_number().over(order).alias("nth"), F.count("*").over(Window.partitionBy("base")).alias("n"))
    return ranked.where(F.col("nth") == F.least("n", F.lit(2))).select("base", "name")


def pick_attributes(df: DataFrame, keep: Sequence[str] = KEY) -> DataFrame:
    """``keep`` and the columns that ``attribute_columns`` picks, in their order."""
    rows = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, name string")
    picked = {r["name"] for r in attribute_columns(rows).collect()}  # column names, not rows
    return df.select(*keep, *[c for c in df.columns if c in picked and c not in keep])


def analysis_subset(signatures: DataFrame, attributes: DataFrame, grades: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Non-anomalous, unregulated, grade A or B series with the permafrost share kept in 0..100."""
    k = list(keys)
    return (
        signatures.where(~F.col("is_anomalous")).join(attributes, k).join(grades.select(*k, "overall_grade"), k, "left")
        .where((F.col("regulation") == 0) & F.col("overall_grade").isin(*HIGH))
        .withColumn("permafrost", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("permafrost"))))
    )
