"""Building and reading the release tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ingest as IN

KEY = ("series_id",)
# No-data number of station files and a folder name that is not an id.
NO_DATA = -999.0
RESERVED = "weights"


def complete_calendar(a: DataFrame, b: DataFrame, start: str, end: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Two products on a dense calendar with the availability of the first in percent.

    Only days with a value are shuffled and sorted: each is followed by the empty days up to the next
    one, and a mark before the first day of the calendar by those ahead of the first value.
    """
    k = list(keys)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    within = lambda d, name: d.where(F.col("date").between(first, last) & F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in k))).select(*k, "date", F.col("value").alias(name))
    both = within(a, "p_a").join(within(b, "p_b"), [*k, "date"], "full_outer").withColumn("_mark", F.lit(False))
    marks = a.select(*k).distinct().select(*k, F.date_sub(first, 1).alias("date"), F.lit(True).alias("_mark"))
    rows = both.unionByName(marks, allowMissingColumns=True)
    w, order = Window.partitionBy(*k), Window.partitionBy(*k).orderBy("date")
    rows = rows.withColumn("_next", F.coalesce(F.lead("date").over(order), F.date_add(last, 1)))
    # Rows that a day stands for: itself, unless it is the mark, and the empty days behind it.
    gap = F.greatest(F.datediff("_next", "date") - 1, F.lit(0))
    size = gap + F.when(F.col("_mark"), 0).otherwise(1)
    rows = rows.withColumn("availability", F.round(F.count("p_a").over(w) / F.sum(size).over(w) * 100, 0)).withColumn("_known", F.max("_mark").over(w)).where("_known")
    steps = F.sequence(F.col("_mark").cast("int"), gap)
    days = rows.where(size > 0).select(*k, "date", "p_a", "p_b", "availability", F.explode(steps).alias("_step"))
    here = F.col("_step") == 0
    return days.select(*k, F.date_add("date", F.col("_step")).alias("date"), F.when(here, F.col("p_a")).alias("p_a"), F.when(here, F.col("p_b")).alias("p_b"), "availability")


def common_ids(a: DataFrame, b: DataFrame, id_col: str = "series_id") -> DataFrame:
    """Ids present in both sources, without the reserved name."""
    return a.select(id_col).intersect(b.select(id_col)).where(F.col(id_col) != RESERVED)


def choose_source(raw: DataFrame, filled: DataFrame, notes: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Filled values for the series that carry a provenance note, raw values for all others.

    Having a filled row is not enough; only the note decides.
    """
    k = [*keys, "date"]
    n = notes.select(*keys, F.lit(True).alias("_note")).distinct()
    f = filled.select(*k, *[F.col(c).alias(f"_f_{c}") for c in columns])
    j = raw.join(n, list(keys), "left").join(f, k, "left")
    return j.select(*k, *[F.when(F.col("_note"), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def release_flow(primary: DataFrame, fallback: DataFrame, masks: DataFrame, anomaly: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Depth and volume with quality code and anomaly mark; series of the primary source win whole.

    ``primary`` and ``fallback`` are ``(keys, date, q_mm, q_cms)``, ``masks`` ``(keys, date, fill_mask)``.
    """
    k = list(keys)
    rest = fallback.join(primary.select(*k).distinct(), k, "left_anti")
    both = primary.select(*k, "date", "q_mm", "q_cms").unionByName(rest.select(*k, "date", "q_mm", "q_cms"))
    j = both.join(masks, [*k, "date"], "left").join(anomaly, k, "left")
    code = IN.quality_codes(F.col("q_cms").isNotNull(), F.coalesce(F.col("fill_mask") == 1, F.lit(False)))
    return j.select(*k, "date", "q_mm", "q_cms", code.alias("quality_flag"), F.coalesce("anomaly", F.lit(-1)).alias("anomaly"))


def release_forcing(days: DataFrame, products: dict[str, DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """Forcing variables on a shared id × day grid, null where a product has no value."""
    k = [*keys, "date"]
    out = days.select(*k)
    for name, p in products.items():
        out = out.join(p.select(*k, F.col("value").alias(name)), k, "left")
    return out


def release_level(
    river: DataFrame, reservoir: DataFrame, datum: DataFrame, masks: DataFrame, screen: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Stage, absolute stage, datum, four-code flag, site type and screen; river sites win whole.

    Site type: 0 river, 1 reservoir, -1 without any record.  Codes: 0 observed, 1 filled, 2 zero
    replaced, 3 missing.
    """
    k = list(keys)
    riv = river.select(*k, "date", "lvl_cm", F.lit(0).alias("site_type"))
    res = reservoir.join(river.select(*k).distinct(), k, "left_anti").select(*k, "date", "lvl_cm", F.lit(1).alias("site_type"))
    j = riv.unionByName(res).join(datum, k, "left").join(masks, [*k, "date"], "left").join(screen.select(*k, "screen"), k, "left")
    w = Window.partitionBy(*k)
    code = F.when(F.col("lvl_cm").isNull(), IN.MISSING).otherwise(F.coalesce(F.col("fill_mask").cast("int"), F.lit(IN.OBSERVED)))
    return j.select(
        *k, "date", "lvl_cm", (F.col("datum") + F.col("lvl_cm") / 100).alias("lvl_abs"), "datum", code.cast("int").alias("quality_flag"),
        F.when(F.count("lvl_cm").over(w) > 0, F.col("site_type")).otherwise(-1).alias("site_type"), F.coalesce("screen", F.lit(-1)).alias("screen"),
    )


def overwrite_datums(first: DataFrame, second: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Two datum tables where the later one overwrites the earlier."""
    return IN.coalesce_tables(second, first, keys, ["datum"])


def recommended_columns(attributes: DataFrame, metadata: Sequence[tuple[str, bool]], id_col: str = "series_id") -> DataFrame:
    """Keep the columns marked as recommended; metadata and table must name the same columns."""
    named = {n for n, _ in metadata}
    have = set(attributes.columns) - {id_col}
    if named != have:
        raise ValueError(f"metadata and columns differ: {sorted(named ^ have)}")
    return attributes.select(id_col, *[n for n, keep in metadata if keep])


def observed_only(df: DataFrame, value: str = "value", flag: str = "quality_flag") -> DataFrame:
    """Null every value whose quality code is not 0."""
    return df.withColumn(value, F.when(F.col(flag) == 0, F.col(value)))


def id_report(df: DataFrame, id_col: str = "series_id") -> DataFrame:
    """Null, blank and duplicate ids of a dimension table."""
    c = F.col(id_col).cast("string")
    per = df.groupBy(c.alias("id")).agg(F.count("*").alias("c"))
    return per.agg(
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("c"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.trim("id") == "", F.col("c"))), F.lit(0)).alias("n_blank"),
        F.count_if((F.col("c") > 1) & F.col("id").isNotNull()).alias("n_duplicated"),
    )


def require_ids(df: DataFrame, id_col: str = "series_id") -> DataFrame:
    """Ids as trimmed text; null, blank or repeated ids raise."""
    r = id_report(df, id_col).first()
    if any(r[c] for c in ("n_null", "n_blank", "n_duplicated")):
        raise ValueError(f"invalid ids: {r.asDict()}")
    return df.withColumn(id_col, F.col(id_col).cast("string"))


def parse_station_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(file, key, value)`` headers and ``(file, date, value)`` bodies from ``(file, line)`` rows.

    Header lines look like ``# key: value``, body lines like ``YYYY-MM-DD;time;value``.
    """
    head = lines.where(F.col("line").startswith("#")).select(
        "file", F.lower(F.trim(F.regexp_extract("line", r"^#\s*([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^#[^:]*:(.*)$", 1)).alias("value")
    ).where("key <> ''")
    body = lines.where(F.col("line").rlike(r"^\d{4}-\d{2}-\d{2};"))
    p = F.split("line", ";")
    v = F.element_at(p, -1).try_cast("double")
    out = body.select("file", F.element_at(p, 1).try_cast("date").alias("date"), F.nullif(v, F.lit(NO_DATA)).alias("value"))
    return head, out.where("date IS NOT NULL")


def stations_in_country(head: DataFrame, body: DataFrame, country: str, first_day: str) -> tuple[DataFrame, DataFrame]:
    """Files of a country still active after a day, and a one-row count of the country's stations."""
    meta = head.groupBy("file").agg(
        F.max(F.when(F.col("key") == "country", F.col("value"))).alias("country"), F.max(F.when(F.col("key") == "station", F.col("value"))).alias("station")
    ).where(F.col("country") == country)
    last = body.groupBy("file").agg(F.max("date").alias("last_date"), F.count("value").alias("n_values"))
    active = meta.join(last, "file").where(F.col("last_date") >= F.lit(first_day).cast("date"))
    return active, meta.agg(F.count_distinct("station").alias("n_country_stations"))


def grade_map(text: DataFrame, column: str = "json") -> DataFrame:
    """``(grade, series_id)`` rows from a JSON map of grade to id list."""
    m = text.select(F.from_json(column, "map<string, array<string>>").alias("m"))
    return m.select(F.explode("m").alias("grade", "ids")).select("grade", F.explode("ids").alias("series_id"))


def attach_notes(summary: DataFrame, notes: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Note text per series, empty where there is none."""
    return summary.join(notes.select(*keys, "note"), list(keys), "left").withColumn("note", F.coalesce("note", F.lit("")))


def orphan_notes(summary: DataFrame, notes: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Noted series that the summary does not list."""
    return notes.join(summary.select(*keys).distinct(), list(keys), "left_anti").select(*keys)
