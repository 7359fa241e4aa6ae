"""Gridded fields to catchments: cell weights, weighted and touched-cell means, extents.

The field is a long table ``(lat, lon, date, variables…)``.  Catchment weights are computed once
per grid, stored as ``(poly_id, lat, lon, w)`` and joined; a day's mean is then one aggregation.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats as S
from ..functions.lineage import stash
from ..functions.skew import finer
from . import spatial as SP

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Water variables, unit factors to millimetres, area bound between both methods (km2).
WATER = ("prcp", "precip", "precipitation", "tp", "et", "evap", "evaporation")
CLIPPED = ("prcp", "precip", "precipitation", "et", "evap")
UNIT_FACTOR = {"m": 1000.0, "mm": 1.0}
SMALL_KM2 = 5.0
CELLS_PER_ROW = 256
TILE = 1.0  # side of a block's corner area, in the grid's units
BLOCK_ROWS = 1 << 16  # weights of a block
STEP_ROWS = 1 << 21  # records and sums held at once inside a block


def unit_factor(variable: str, unit: str) -> float:
    """Factor to millimetres for water variables, 1 for the rest."""
    if unit not in UNIT_FACTOR:
        raise ValueError(f"unknown unit: {unit}")
    return UNIT_FACTOR[unit] if variable.lower() in WATER else 1.0


def aggregation_rule(variable: str, totals: bool = False) -> str:
    """``sum`` for totals products and water variables, else ``mean``."""
    parts = ("precipitation", "evaporation", "tot_prec", "pr", "prcp")
    return "sum" if totals or any(p in variable for p in parts) else "mean"


def aggregate_by_rule(df: DataFrame, variables: Sequence[str], by: Sequence[str], totals: Sequence[str] = ()) -> DataFrame:
    """Every variable summed or averaged per group, as its rule says; ``totals`` names columns of totals products."""
    rule = {v: F.sum if aggregation_rule(v, v in totals) == "sum" else F.avg for v in variables}
    return df.groupBy(*by).agg(*[fn(v).alias(v) for v, fn in rule.items()])


def snap(v: Column, res: float) -> Column:
    """Integer key of the grid line nearest to a coordinate."""
    return F.floor(v / res + 0.5)


def snapped_extents(vertices: DataFrame, res: float) -> DataFrame:
    """Box of each polygon on grid lines, widened by one cell where it spans two or fewer."""
    b = SP.bounding_boxes(vertices)
    keys = b.select("poly_id", *[snap(F.col(c), res).alias(c) for c in ("x1", "y1", "x2", "y2")])
    wide = lambda lo, hi: F.col(hi) - F.col(lo) <= 2
    gx, gy = wide("x1", "x2"), wide("y1", "y2")
    return keys.select(
        "poly_id", (F.col("x1") - gx.cast("int")).alias("x1"), (F.col("x2") + gx.cast("int")).alias("x2"),
        (F.col("y1") - gy.cast("int")).alias("y1"), (F.col("y2") + gy.cast("int")).alias("y2"),
    )


def cells_in_extent(vertices: DataFrame, cells: DataFrame, res: float) -> DataFrame:
    """``(poly_id, lat, lon)`` of the grid cells within each polygon's snapped box."""
    e = snapped_extents(vertices, res).select("poly_id", F.explode(F.sequence("x1", "x2")).alias("kx"), "y1", "y2").select(
        "poly_id", "kx", F.explode(F.sequence("y1", "y2")).alias("ky")
    )
    keyed = cells.select("lat", "lon").distinct().select("lat", "lon", snap(F.col("lon"), res).alias("kx"), snap(F.col("lat"), res).alias("ky"))
    return e.join(keyed, ["kx", "ky"]).select("poly_id", "lat", "lon")


def _half(ring: np.ndarray, axis: int, bound: float, sign: int) -> np.ndarray:
    """The part of a ring on one side of an axis-parallel line."""
    if len(ring) == 0:
        return ring
    d = sign * (ring[:, axis] - bound)
    after, dn = np.roll(ring, -1, axis=0), np.roll(d, -1)
    cross = ((d > 0) & (dn < 0)) | ((d < 0) & (dn > 0))
    t = np.divide(d, d - dn, out=np.zeros_like(d), where=cross)
    both = np.stack([ring, ring + (after - ring) * t[:, None]], 1)
    return both[np.stack([d >= 0, cross], 1)]


def fractional_weights(vertices: DataFrame, cells: DataFrame, res: float) -> DataFrame:
    """Overlap share ``(poly_id, lat, lon, w)`` of every cell, summing to one per polygon.

    Overlaps of a polygon's rings are added, those of holes taken off.  A ring is cut once per row of
    the grid, then cell by cell inside that narrow band, so its length enters once per row and
    not once per cell; the row's cells travel in chunks, and areas are computed as columns.
    """
    half = res / 2.0
    corners = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))

    @F.pandas_udf(corners)
    def overlaps(ring: pd.Series, lat: pd.Series, lons: pd.Series) -> pd.Series:
        out = []
        for r, y, xs in zip(ring, lat, lons):
            pts = np.array([[p["x"], p["y"]] for p in r], float)
            band = _half(_half(pts, 1, y - half, 1), 1, y + half, -1)
            cut = (_half(_half(band, 0, x - half, 1), 0, x + half, -1) for x in xs)
            out.append([[{"x": a, "y": b} for a, b in c] for c in cut])
        return pd.Series(out)

    pairs = cells_in_extent(vertices, cells, res)
    # Cells of a row in order of longitude, cut into chunks by the grid itself.
    chunk = F.floor(F.col("lon") / (CELLS_PER_ROW * res))
    chunks = pairs.groupBy("poly_id", "lat", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("lon")).alias("lons"))
    shapes = SP.rings(vertices).where(F.size("vertices") > 2).select("poly_id", "part", "ring", "hole", "vertices")
    # Few bytes, much work: without a fixed number of parts adaptive execution would leave one or two tasks.
    rows = finer(chunks, "poly_id", times=1).join(shapes, "poly_id").select("poly_id", "lat", "hole", F.explode(F.arrays_zip("lons", overlaps("vertices", "lat", "lons").alias("c"))).alias("z"))
    area = SP.ring_area(F.col("z.c"))
    raw = rows.where(F.size("z.c") > 2).select("poly_id", "lat", F.col("z.lons").alias("lon"), F.when(F.col("hole"), -area).otherwise(area).alias("a"))
    total = raw.groupBy("poly_id", "lat", "lon").agg(F.sum("a").alias("a")).where("a > 1e-9")  # a cell inside a hole leaves only rounding
    return total.select("poly_id", "lat", "lon", (F.col("a") / F.sum("a").over(Window.partitionBy("poly_id"))).alias("w"))


def grid_signature(cells: DataFrame) -> DataFrame:
    """One-row key of a grid: distinct cell count and an order-free hash of coordinates to 1e-6."""
    c = cells.select(F.round(F.col("lat") * 1e6).cast("long").alias("a"), F.round(F.col("lon") * 1e6).cast("long").alias("b")).distinct()
    return c.agg(F.count("*").alias("n_cells"), F.bit_xor(F.xxhash64("a", "b")).alias("hash"))


def stale_polygons(stored: DataFrame, vertices: DataFrame, cells: DataFrame, res: float) -> DataFrame:
    """Polygons whose stored cells are not the cells of their extent on this grid (to 1e-6).

    ``stored`` is the whole extent the weights were computed for: ``(poly_id, lat, lon)``.
    """
    key = lambda d: d.select("poly_id", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("lat", "lon")])
    now = key(cells_in_extent(vertices, cells, res)).withColumn("_n", F.lit(1))
    old = key(stored).withColumn("_o", F.lit(1))
    j = now.join(old, ["poly_id", "lat", "lon"], "full_outer")
    return j.where("_n IS NULL OR _o IS NULL").select("poly_id").distinct()


def _block_sums(variables: Sequence[str]):
    """Sums of one block: its records and its weights joined by cell, added up by polygon and day."""

    def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        d = pa.concat_arrays(column.chunks).dictionary_encode("encode")
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary

    def sums(field: pa.Table, weights: pa.Table) -> pa.Table:
        if not field.num_rows or not weights.num_rows:
            return pa.table({})
        n = field.num_rows
        code = np.zeros(n + weights.num_rows, np.int64)
        for c in ("lat", "lon"):
            values, at = np.unique(np.concatenate([field[c].to_numpy(), weights[c].to_numpy()]), return_inverse=True)
            code = code * len(values) + at
        order = np.argsort(code[:n], kind="stable")
        days, dates = coded(field["date"])
        polys, ids = coded(weights["poly_id"])
        by_poly = np.argsort(polys, kind="stable")
        polys, cells = polys[by_poly], code[n:][by_poly]
        w = weights["w"].fill_null(0.0).to_numpy()[by_poly]
        has_w = weights["w"].is_valid().to_numpy()[by_poly]
        records = code[:n][order]
        start = np.searchsorted(records, cells, "left")
        length = np.searchsorted(records, cells, "right") - start
        day = days[order]
        x = {v: field[v].fill_null(0.0).to_numpy()[order] for v in variables}
        valid = {v: field[v].is_valid().to_numpy()[order] for v in variables}
        # Polygons in steps that hold a bounded number of records and of sums.
        cost = np.maximum(np.bincount(polys, weights=length, minlength=len(ids)), len(dates))
        step = (np.cumsum(cost) // STEP_ROWS)[polys]
        out = []
        for s in np.unique(step):
            i = np.flatnonzero(step == s)
            first, k = polys[i[0]], length[i]
            at = np.repeat(start[i] - np.cumsum(k) + k, k) + np.arange(k.sum())
            key = np.repeat(polys[i] - first, k) * np.int64(len(dates)) + day[at]
            size = int((polys[i[-1]] - first + 1) * len(dates))
            hit = np.flatnonzero(np.bincount(key, minlength=size))
            wk, known = np.repeat(w[i], k), np.repeat(has_w[i], k)
            columns = [ids.take(pa.array(hit // len(dates) + first)), dates.take(pa.array(hit % len(dates)))]
            for v in variables:
                ok = valid[v][at] & known
                none = np.bincount(key, weights=ok, minlength=size)[hit] == 0
                total, share = np.bincount(key, weights=np.where(ok, x[v][at] * wk, 0.0), minlength=size)[hit], np.bincount(key, weights=np.where(ok, wk, 0.0), minlength=size)[hit]
                columns += [pa.array(total, mask=none), pa.array(share, mask=none)]
            out.append(pa.Table.from_arrays(columns, ["poly_id", "date", *[f"{c}_{v}" for v in variables for c in ("_a", "_w")]]))
        return pa.concat_tables(out)

    return sums


def daily_sums(field: DataFrame, weights: DataFrame, variables: Sequence[str], tile: float = TILE) -> DataFrame:
    """``(poly_id, date, _a_v, _w_v ...)``: sums of value times weight, and of the weights with a value, per variable.

    Polygons that fit a tile are dealt to blocks by the tile of their lowest corner, crowded tiles to several;
    the records of a cell travel to the blocks that use it, and sums are made there, so that no row
    stands for a cell, a polygon and a day in a shuffle.  A block holds the records of at most four
    tiles.  Wider polygons are joined by cell and added up by polygon and day over all tasks.
    """
    w = stash(weights.select("poly_id", "lat", "lon", F.col("w").cast("double").alias("w")), "grid-weights")
    box = w.groupBy("poly_id").agg(*[f(c).alias(n) for f, c, n in ((F.min, "lon", "x1"), (F.max, "lon", "x2"), (F.min, "lat", "y1"), (F.max, "lat", "y2"))], F.count("*").alias("n"))
    box = box.withColumn("wide", (F.col("x2") - F.col("x1") > tile) | (F.col("y2") - F.col("y1") > tile))
    f = field.select("lat", "lon", "date", *[F.col(v).cast("double").alias(v) for v in variables])
    home = box.where("NOT wide").select("poly_id", "n", F.floor(F.col("x1") / tile).alias("tx"), F.floor(F.col("y1") / tile).alias("ty"))
    crowd = home.groupBy("tx", "ty").agg(F.ceil(F.sum("n") / BLOCK_ROWS).alias("parts"))
    block = home.join(crowd, ["tx", "ty"]).select("poly_id", F.xxhash64("tx", "ty", F.pmod(F.xxhash64("poly_id"), F.col("parts"))).alias("block"))
    narrow = stash(w.join(block, "poly_id"), "grid-blocks")
    spread = f.join(narrow.select("lat", "lon", F.col("block").alias("part")).distinct(), ["lat", "lon"])
    names = [f"{c}_{v}" for v in variables for c in ("_a", "_w")]
    schema = T.StructType([T.StructField("poly_id", w.schema["poly_id"].dataType), T.StructField("date", f.schema["date"].dataType), *[T.StructField(c, T.DoubleType()) for c in names]])
    place = [F.col(c).cast("double").alias(c) for c in ("lat", "lon")]
    records = spread.select("part", *place, "date", *variables).groupBy("part")
    sums = records.cogroup(narrow.select("block", "poly_id", *place, "w").groupBy("block")).applyInArrow(_block_sums(list(variables)), schema)
    far = w.join(box.where("wide").select("poly_id"), "poly_id", "left_semi")
    if far.isEmpty():
        return sums
    aggs = [a for v in variables for a in (F.sum(F.col(v) * F.col("w")).alias(f"_a_{v}"), F.sum(F.when(F.col(v).isNotNull(), F.col("w"))).alias(f"_w_{v}"))]
    return sums.unionByName(f.join(far, ["lat", "lon"]).groupBy("poly_id", "date").agg(*aggs))


def catchment_means(
    field: DataFrame, weights: DataFrame, variables: Sequence[str], areas: DataFrame | None = None,
    unit: str = "mm", small_km2: float = SMALL_KM2,
) -> DataFrame:
    """Daily means per catchment, null-aware per variable.

    With ``areas`` given, catchments below ``small_km2`` use the weights and the others the plain
    mean of touched cells; both are one aggregation, as a touched cell is a weight of one.
    Without ``areas`` every catchment is weighted.
    """
    w = weights
    if areas is not None:
        w = w.join(areas.select("poly_id", "area_km2"), "poly_id").withColumn(
            "w", F.when(F.col("area_km2") < small_km2, F.col("w")).otherwise(1.0)
        )
    means = []
    for v in variables:
        m = S.div(F.col(f"_a_{v}"), F.col(f"_w_{v}")) * unit_factor(v, unit)
        means.append((F.greatest(m, F.lit(0.0)) if v in CLIPPED else m).alias(v))
    return daily_sums(field, w, variables).select("poly_id", "date", *means)


def touched_means(
    field: DataFrame, weights: DataFrame, vertices: DataFrame, variables: Sequence[str], res: float, unit: str = "mm",
    cells: DataFrame | None = None,
) -> DataFrame:
    """Plain mean of touched cells; a polygon that touches none takes its whole extent.

    ``cells`` is the grid ``(lat, lon)``; without it the field is scanned for its cells.
    """
    ext = cells_in_extent(vertices, field if cells is None else cells, res)
    touched = weights.where("w > 0").select("poly_id", "lat", "lon").withColumn("_t", F.lit(1))
    tag = ext.join(touched, ["poly_id", "lat", "lon"], "left")
    tag = tag.withColumn("_any", F.max("_t").over(Window.partitionBy("poly_id"))).where("_t = 1 OR _any IS NULL")
    return catchment_means(field, tag.select("poly_id", "lat", "lon", F.lit(1.0).alias("w")), variables, unit=unit)


def band_sensitivity(
    weighted: DataFrame, touched: DataFrame, areas: DataFrame, variable: str, bounds: Sequence[float], labels: Sequence[str],
) -> DataFrame:
    """Relative difference of annual totals between both methods per area band: n, median, p90."""
    from ..functions.quantiles import exact_quantiles

    a = F.col("area_km2")
    band = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(bounds[:-1], bounds[1:], labels))):
        band = F.when((a >= lo) & (a < hi), label).otherwise(band)
    sites = areas.select("poly_id", band.alias("band")).where("band IS NOT NULL")
    year = lambda d, n: d.groupBy("poly_id", F.year("date").alias("year")).agg(F.sum(variable).alias(n))
    j = year(weighted, "a").join(year(touched, "b"), ["poly_id", "year"]).join(sites, "poly_id")
    j = j.withColumn("rel", F.abs(S.div(F.col("a") - F.col("b"), F.col("b"))) * 100)
    n = j.groupBy("band").agg(F.count("rel").alias("n"))
    return n.join(exact_quantiles(j, ["band"], "rel", {"median_pct": 0.5, "p90_pct": 0.9}), "band")


# --- points on the grid --------------------------------------------------------------------------------------


def nearest_valid_cells(points: DataFrame, cells: DataFrame, res: float = 0.1, max_west: float = 5.0) -> DataFrame:
    """Cell nearest to each point, or the first valid one to the west of it on the same grid row.

    ``cells`` is ``(lat, lon, v)`` with null for cells without data.  A point whose row holds no
    valid cell within reach keeps its own coordinates and ``shifted`` null.
    """
    steps = int(round(max_west / res))
    c = cells.where("v IS NOT NULL").select("lat", "lon", snap(F.col("lon"), res).alias("kx"), snap(F.col("lat"), res).alias("ky")).distinct()
    p = points.select("series_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"), snap(F.col("lat"), res).alias("ky"), snap(F.col("lon"), res).alias("px"))
    tries = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).withColumn("kx", F.col("px") - F.col("k"))
    hit = tries.join(c, ["kx", "ky"]).groupBy("series_id").agg(
        F.min("k").alias("shifted"), F.min_by("lat", "k").alias("lat"), F.min_by("lon", "k").alias("lon")
    )
    return p.join(hit, "series_id", "left").select(
        "series_id", F.coalesce("lat", "plat").alias("lat"), F.coalesce("lon", "plon").alias("lon"), "shifted"
    )


def point_series(points: DataFrame, field: DataFrame, variables: Sequence[str], res: float = 0.1) -> DataFrame:
    """Daily series of the cell nearest to each point, days from overlapping files averaged."""
    p = points.select("series_id", snap(F.col("lat"), res).alias("ky"), snap(F.col("lon"), res).alias("kx"))
    f = field.select("date", *variables, snap(F.col("lat"), res).alias("ky"), snap(F.col("lon"), res).alias("kx"))
    return f.join(p, ["kx", "ky"]).groupBy("series_id", "date").agg(*[F.avg(v).alias(v) for v in variables])
