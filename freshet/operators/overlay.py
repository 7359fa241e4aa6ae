"""Areas in which polygons of two tables overlap, with parts and holes, on an equal-area plane.

Longitude and the sine of latitude span a plane on which areas are those of the sphere.  Each polygon is covered by
quadtree cells: a cell within the polygon is kept as it is, one that an edge crosses is split until few edges are left
in it.  Two polygons overlap where a cell of one lies in a cell of the other, so the join is on equal cell keys, a cell
being listed under its ancestors; a large polygon is some cells along its border and few large ones inside, not every small
cell of its box.  Only where borders may cross are the rings themselves compared.

The overlap of two sets of rings is added up in vertical strips between all corners and crossings.  Inside a strip
edges do not cross, so from bottom to top they only switch one side on or off.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stash
from ..functions.skew import salted_join
from .grid import _half
from .spatial import AREA_RADIUS, rings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORNERS = 12  # of the rings in a cell that is not split further
DEPTH, DEEPEST = 8, 24  # splits of one polygon's first cells; level of the smallest cells
KM2 = (np.pi / 180 * AREA_RADIUS / 1000) ** 2  # km² of a square unit of the plane


def flat(lonlat: np.ndarray) -> np.ndarray:
    """Longitude in degrees and the sine of latitude in the same unit."""
    return np.stack([lonlat[:, 0], np.degrees(np.sin(np.radians(lonlat[:, 1])))], axis=1)


def _edges(shape: Sequence[np.ndarray]) -> np.ndarray:
    """``x1, y1, x2, y2`` of all edges that are not vertical, from left to right."""
    parts = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in shape if len(r) > 2]
    if not parts:
        return np.empty((0, 4))
    e = np.concatenate(parts)
    e = e[e[:, 0] != e[:, 2]]
    return np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)


def _crossings(e: np.ndarray) -> np.ndarray:
    """x of all proper crossings of two edges."""
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    i, j = np.triu_indices(len(e), 1)
    lo, hi = np.maximum(e[i, 0], e[j, 0]), np.minimum(e[i, 2], e[j, 2])
    meet = (lo < hi) & (slope[i] != slope[j])
    i, j, lo, hi = i[meet], j[meet], lo[meet], hi[meet]
    x = (base[j] - base[i]) / (slope[i] - slope[j])
    return x[(x > lo) & (x < hi)]


def overlap_area(a: Sequence[np.ndarray], b: Sequence[np.ndarray] | None = None) -> float:
    """Area inside an odd number of rings of ``a`` and an odd number of rings of ``b`` (of ``a`` alone without ``b``)."""
    ea = _edges(a)
    eb = _edges(b) if b is not None else ea[:0]
    if not len(ea) or (b is not None and not len(eb)):
        return 0.0
    if b is not None:  # only strips that both sides reach
        lo, hi = max(ea[:, 0].min(), eb[:, 0].min()), min(ea[:, 2].max(), eb[:, 2].max())
        ea, eb = (e[(e[:, 0] < hi) & (e[:, 2] > lo)] for e in (ea, eb))
    e = np.concatenate([ea, eb])
    of_a = np.arange(len(e)) < len(ea)
    xs = np.unique(np.concatenate([e[:, 0], e[:, 2], _crossings(e)]))
    if len(xs) < 2:
        return 0.0
    left, right = xs[:-1, None], xs[1:, None]
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    here = (e[:, 0] <= left) & (e[:, 2] >= right)
    y1, y2 = (e[:, 1] + slope * (x - e[:, 0]) for x in (left, right))
    order = np.argsort(np.where(here, y1 + y2, np.inf), axis=1, kind="stable")
    here, y1, y2 = (np.take_along_axis(v, order, axis=1) for v in (here, y1, y2))
    mine = of_a[order]
    inside = np.cumsum(here & mine, axis=1) % 2 == 1
    if b is not None:
        inside &= np.cumsum(here & ~mine, axis=1) % 2 == 1
    inside = inside[:, :-1] & here[:, 1:]
    height = (y1[:, 1:] - y1[:, :-1] + y2[:, 1:] - y2[:, :-1]) / 2
    return float((np.where(inside, height, 0.0) * (right - left)).sum())


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)[:-1]]).astype(int)


def overlap_areas(ea: np.ndarray, na: np.ndarray, eb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """``overlap_area`` of many pairs at once: the edges of all pairs one after the other, and their numbers by pair."""
    out = np.zeros(len(na))
    sides = []
    some = (na > 0) & (nb > 0)
    for e, n in ((ea, na), (eb, nb)):
        row = np.repeat(np.arange(len(n)), n)
        lo, hi = np.full(len(n), np.inf), np.full(len(n), -np.inf)
        if len(e):
            full = np.flatnonzero(n)
            lo[full], hi[full] = np.minimum.reduceat(e[:, 0], _starts(n)[full]), np.maximum.reduceat(e[:, 2], _starts(n)[full])
        sides.append((e, row, lo, hi))
    lo, hi = np.maximum(sides[0][2], sides[1][2]), np.minimum(sides[0][3], sides[1][3])
    kept = []
    for e, row, _, _ in sides:  # only strips that both sides reach
        keep = some[row] & (e[:, 0] < hi[row]) & (e[:, 2] > lo[row])
        kept.append((e[keep], row[keep], np.bincount(row[keep], minlength=len(na))))
    (ea, ra, na), (eb, rb, nb) = kept
    total = np.where((na > 0) & (nb > 0), na + nb, 0)
    order = np.argsort(total, kind="stable")
    order = order[total[order] > 0]
    sa, sb = _starts(na), _starts(nb)
    while len(order):
        wide = 1 << int(np.ceil(np.log2(total[order[0]])))  # pairs of similar numbers of edges, in blocks of bounded size
        many = min(int(np.searchsorted(total[order], wide, side="right")), max(1, 400_000 // wide**2))
        rows, order = order[:many], order[many:]
        wide = int(total[rows].max())
        e = np.full((many, wide, 4), np.nan)
        spot = np.arange(wide)
        mine = spot < na[rows][:, None]
        other = ~mine & (spot < total[rows][:, None])
        e[mine] = ea[(sa[rows][:, None] + spot)[mine]]
        e[other] = eb[(sb[rows][:, None] + spot - na[rows][:, None])[other]]
        out[rows] = _strip_areas(e, mine)
    return out


def _strip_areas(e: np.ndarray, of_a: np.ndarray) -> np.ndarray:
    """Areas of a block of pairs, ``(pair, edge, 4)`` filled up with NaN."""
    slope = (e[..., 3] - e[..., 1]) / (e[..., 2] - e[..., 0])
    base = e[..., 1] - slope * e[..., 0]
    i, j = np.triu_indices(e.shape[1], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (base[:, j] - base[:, i]) / (slope[:, i] - slope[:, j])
    x[~((x > np.maximum(e[:, i, 0], e[:, j, 0])) & (x < np.minimum(e[:, i, 2], e[:, j, 2])))] = np.nan
    xs = np.sort(np.concatenate([e[..., 0], e[..., 2], x], axis=1), axis=1)
    xs[:, 1:][xs[:, 1:] == xs[:, :-1]] = np.nan
    xs = np.sort(xs, axis=1)
    n = np.maximum((~np.isnan(xs)).sum(axis=1), 2)
    out = np.zeros(len(e))
    order = np.argsort(n, kind="stable")
    while len(order):
        few = max(1, 400_000 // (int(n[order[0]]) * e.shape[1]))
        few = min(few, int(np.searchsorted(n[order], 2 * n[order[0]], side="right")))
        rows, order = order[:few], order[few:]
        at = xs[rows, : n[rows].max()]
        left, right = at[:, :-1, None], at[:, 1:, None]
        block, k, b = e[rows][:, None], slope[rows][:, None], of_a[rows][:, None]
        here = (block[..., 0] <= left) & (block[..., 2] >= right)
        y1, y2 = (block[..., 1] + k * (v - block[..., 0]) for v in (left, right))
        rank = np.argsort(np.where(here, y1 + y2, np.inf), axis=2, kind="stable")
        here, y1, y2, mine = (np.take_along_axis(v, rank, axis=2) for v in (here, y1, y2, np.broadcast_to(b, here.shape)))
        inside = (np.cumsum(here & mine, axis=2) % 2 == 1) & (np.cumsum(here & ~mine, axis=2) % 2 == 1)
        inside = inside[..., :-1] & here[..., 1:]
        height = (y1[..., 1:] - y1[..., :-1] + y2[..., 1:] - y2[..., :-1]) / 2
        out[rows] = np.where(inside, height * (right - left), 0.0).sum(axis=(1, 2))
    return out


def clipped(shape: Sequence[np.ndarray], box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The rings within a box; pieces stay joined along its sides, where they enclose no area."""
    out = []
    for ring in shape:
        low, high = ring.min(axis=0), ring.max(axis=0)
        if low[0] >= box[2] or low[1] >= box[3] or high[0] <= box[0] or high[1] <= box[1]:
            continue
        for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
            if len(ring) and (low[axis] < bound if sign > 0 else high[axis] > bound):
                ring = _half(ring, axis, bound, sign)
        if len(ring) > 2:
            out.append(ring)
    return out


def cell_box(level: int, cx: int, cy: int) -> tuple[float, float, float, float]:
    size = 360.0 / (1 << level)
    return cx * size - 180, cy * size - 180, (cx + 1) * size - 180, (cy + 1) * size - 180


def cover(shape: list[np.ndarray]) -> list[tuple[int, int, int, bool, float, list[np.ndarray]]]:
    """``level, cx, cy, inner, area, rings`` of the cells that make up a polygon; inner cells have no rings."""
    return [cell[1:] for cell in covers([shape])]


def covers(shapes: Sequence[list[np.ndarray]]) -> list[tuple[int, int, int, int, bool, float, list[np.ndarray]]]:
    """The cells of several polygons, each after the polygon's number; areas of one level of splits come together."""
    todo, out = [], []
    for k, shape in enumerate(shapes):
        shape = [r for r in shape if len(r) > 2]
        if not shape:
            continue
        points = np.concatenate(shape)
        low, high = points.min(axis=0), points.max(axis=0)
        first = int(np.clip(np.floor(np.log2(360.0 / max((high - low).max(), 1e-9))), 0, DEEPEST))
        size = 360.0 / (1 << first)
        corner, last = ([min(max(int((x + 180) // size), 0), (1 << first) - 1) for x in v] for v in (low, high))
        todo += [(k, first, first, x, y, shape) for x in range(corner[0], last[0] + 1) for y in range(corner[1], last[1] + 1)]
    while todo:
        boxes = [cell_box(level, cx, cy) for _, _, level, cx, cy, _ in todo]
        owns = [clipped(above, box) for (*_, above), box in zip(todo, boxes)]
        edges = [_edges(own) for own in owns]
        around = np.array([(x1, y, x2, y) for x1, y1, x2, y2 in boxes for y in (y1, y2)])
        areas = overlap_areas(np.concatenate(edges), np.array([len(e) for e in edges]), around, np.full(len(boxes), 2))
        below = []
        for (k, first, level, cx, cy, _), box, own, area in zip(todo, boxes, owns, areas.tolist()):
            whole = (box[2] - box[0]) * (box[3] - box[1])
            if area <= 0:
                continue
            if area >= whole * (1 - 1e-12):
                out.append((k, level, cx, cy, True, whole, []))
            elif sum(map(len, own)) <= CORNERS or level >= min(first + DEPTH, DEEPEST):
                out.append((k, level, cx, cy, False, area, own))
            else:
                below += [(k, first, level + 1, 2 * cx + i, 2 * cy + j, own) for i in (0, 1) for j in (0, 1)]
        todo = below
    return out


def covered(vertices: DataFrame) -> DataFrame:
    """Cells of all polygons: ``poly_id, level, cx, cy, inner, area, edges, box``, edges and box being those of the part in the cell.

    Polygons with a corner beyond a pole enclose nothing: on the plane they would fold back over others.
    """
    shapes = rings(vertices).groupBy("poly_id").agg(F.collect_list(F.transform("vertices", lambda p: F.array(p["x"], p["y"]))).alias("rings"))
    shapes = shapes.where(~F.exists("rings", lambda r: F.exists(r, lambda p: F.coalesce(F.abs(p[1]) > 90, F.lit(False)))))
    ids = shapes.schema["poly_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            polys = batch.column(0).to_pylist()
            for at in range(0, len(polys), 500):
                plain = [[flat(np.array(r, float)) for r in shape if len(r) > 2 and all(None not in p for p in r)] for shape in batch.column(1)[at : at + 500].to_pylist()]
                for k, level, cx, cy, inner, area, own in covers(plain):
                    x1, y1, x2, y2 = cell_box(level, cx, cy)
                    edges = np.array([(x1, y1, x2, y1), (x1, y2, x2, y2)]) if inner else _edges(own)
                    box = [edges[:, 0].min(), edges[:, [1, 3]].min(), edges[:, 2].max(), edges[:, [1, 3]].max()]
                    rows.append((polys[at + k], level, cx, cy, inner, area, edges.tobytes(), box))
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.binary(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["poly_id", "level", "cx", "cy", "inner", "area", "edges", "box"])

    # Few bytes but much work each, so adaptive plans must not bring them together in few tasks.
    # The key is hashed, as a shuffle by the key itself would be taken from the aggregation before, which they do shrink.
    spread = shapes.repartition(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("poly_id"))
    return spread.mapInArrow(run, f"poly_id {ids}, level int, cx bigint, cy bigint, inner boolean, area double, edges binary, box array<double>")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a_id, b_id, overlap_km2`` of all pairs of polygons of two vertex tables whose insides meet.

    Rings of fewer than three corners, and rings with a null coordinate, enclose nothing.
    """
    ca, cb = stash(covered(a), "cover-a"), stash(covered(b), "cover-b")  # each is read twice

    def above(cells: DataFrame, strict: bool) -> DataFrame:
        up = F.explode(F.sequence(F.lit(1 if strict else 0), F.col("level"))).alias("up")
        return cells.where("level > 0" if strict else "true").select("*", up).select(
            F.struct(*cells.columns).alias("deep"), (F.col("level") - F.col("up")).alias("l"),
            F.expr("shiftright(cx, up)").alias("x"), F.expr("shiftright(cy, up)").alias("y"), F.xxhash64("poly_id", "cx", "cy").alias("own"))

    def holders(cells: DataFrame) -> DataFrame:
        return cells.select(F.struct(*cells.columns).alias("wide"), F.col("level").alias("l"), F.col("cx").alias("x"), F.col("cy").alias("y"))

    def met(deep: DataFrame, wide: DataFrame, swapped: bool) -> DataFrame:
        # A wide cell may hold most of the other table's cells.
        both = salted_join(deep, wide, ["l", "x", "y"], ["own"])
        for low, high in ((0, 2), (1, 3)):
            for one, two in (("deep", "wide"), ("wide", "deep")):
                both = both.where(F.col(f"{one}.box")[low] < F.col(f"{two}.box")[high])
        first, second = ("wide", "deep") if swapped else ("deep", "wide")
        return both.select(
            F.col(f"{first}.poly_id").alias("a_id"), F.col(f"{second}.poly_id").alias("b_id"), F.col("wide.inner").alias("plain"), F.col("deep.area").alias("area"),
            "deep.level", "deep.cx", "deep.cy", F.when(~F.col("wide.inner"), F.col("deep.edges")).alias("e1"), F.when(~F.col("wide.inner"), F.col("wide.edges")).alias("e2"))

    pairs = met(above(ca, False), holders(cb), False).union(met(above(cb, True), holders(ca), True))
    ids = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a_id", "b_id"))

    def run(batches):
        for batch in batches:
            # The deep part lies in its cell, so the wide one need not be clipped to it.
            sides = []
            for side in ("e1", "e2"):
                v = batch.column(side).to_pylist()
                sides += [np.frombuffer(b"".join(v), float).reshape(-1, 4), np.array([len(x) // 32 for x in v], int)]
            out = overlap_areas(*sides)
            yield pa.RecordBatch.from_arrays([batch.column("a_id"), batch.column("b_id"), pa.array(out, pa.float64())], names=["a_id", "b_id", "area"])

    inside = pairs.where("plain").select("a_id", "b_id", "area")
    work = pairs.where("NOT plain").drop("plain", "area").repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a_id", "b_id", "level", "cx", "cy").select("a_id", "b_id", "e1", "e2")
    crossed = work.mapInArrow(run, f"{ids}, area double")
    sums = inside.union(crossed).groupBy("a_id", "b_id").agg((F.sum("area") * float(KM2)).alias("overlap_km2"))
    return sums.where("overlap_km2 > 0")
