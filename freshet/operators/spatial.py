"""Areas, point-in-polygon joins, nesting, nearest sites and hexagonal cells.

Geometry is a vertex table ``(poly_id, part, ring, seq, lon, lat)``; ring 0 is the outline of a part,
other rings are its holes.  Theta joins become equi-joins on
grid-cell keys with the exact test as a residual; the ring test is a JVM fold over the vertex
array, so no vertex rows are multiplied by candidate pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.lineage import cut
from ..functions.skew import finer, salted_join

# Sphere radii of the area (m) and the two distance formulas (km).
AREA_RADIUS, FEATURE_RADIUS, SITE_RADIUS = 6378137.0, 6371.0088, 6371.0
# Catchment area (km2) that a river class stands for.
CLASS_AREA = {"small_rivers": 80, "medium_rivers": 800, "rivers": 8000, "big_rivers": 80000, "large_rivers": 800000}


# --- areas and boxes ----------------------------------------------------------------------------------


def ring_area(ring: Column, radius: float = AREA_RADIUS) -> Column:
    """Spherical area in km² of an array of ``(x, y)`` vertices: azimuth steps at mean colatitude, folded around the ring."""

    def polar(p: Column) -> Column:
        lat, lon = F.radians(p["y"]), F.radians(p["x"])
        h = F.sin(lat / 2) ** 2 + F.cos(lat) * F.sin(lon / 2) ** 2
        return F.struct((2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))).alias("c"), F.atan2(F.cos(lat) * F.sin(lon), F.sin(lat)).alias("az"))

    def step(acc: Column, p: Column) -> Column:
        turn = F.pmod(p["az"] - acc["az"] + F.pi(), 2 * F.pi()) - F.pi()
        return F.struct(p["c"].alias("c"), p["az"].alias("az"), (acc["s"] + (1 - F.cos((acc["c"] + p["c"]) / 2)) * turn).alias("s"))

    last = polar(F.element_at(ring, -1))
    start = F.struct(last["c"].alias("c"), last["az"].alias("az"), F.lit(0.0).alias("s"))
    share = F.abs(F.aggregate(F.transform(ring, polar), start, step, lambda acc: acc["s"])) / (4 * F.pi())
    return F.when(F.size(ring) > 2, F.least(share, 1 - share) * 4 * F.pi() * radius**2 / 1e6).otherwise(0.0)


def polygon_areas(vertices: DataFrame, keys: Sequence[str] = ("poly_id", "part"), radius: float = AREA_RADIUS) -> DataFrame:
    """Area of each key in km²: its outer rings less its holes."""
    area = ring_area(F.col("vertices"), radius)
    return rings(vertices, keys).groupBy(*keys).agg(F.sum(F.when(F.col("hole"), -area).otherwise(area)).alias("area_km2"))


def largest_parts(areas: DataFrame) -> DataFrame:
    """Largest part of each polygon (the first one on ties)."""
    return areas.groupBy("poly_id").agg(
        F.max_by("part", F.struct("area_km2", -F.col("part"))).alias("part"), F.max("area_km2").alias("area_km2")
    )


def bounding_boxes(vertices: DataFrame, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """Extremes and centre of each polygon's box."""
    b = vertices.groupBy(*keys).agg(
        F.min("lon").alias("x1"), F.min("lat").alias("y1"), F.max("lon").alias("x2"), F.max("lat").alias("y2")
    )
    return b.select("*", ((F.col("x1") + F.col("x2")) / 2).alias("lon_c"), ((F.col("y1") + F.col("y2")) / 2).alias("lat_c"))


def in_box(lon: Column, lat: Column) -> Column:
    """Strictly inside the box columns ``x1, y1, x2, y2``."""
    return (lon > F.col("x1")) & (lon < F.col("x2")) & (lat > F.col("y1")) & (lat < F.col("y2"))


def rings(vertices: DataFrame, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """One row per ring of each key: ``part``, ``ring``, ``hole``, vertex array ``vertices`` in ring order, and the ring's box.

    ``vertices`` may have ``part`` and ``ring`` columns; a ring other than 0 is a hole of its part.
    """
    have = lambda c: F.col(c) if c in vertices.columns else F.lit(0)
    own = [k for k in keys if k not in ("part", "ring")]
    named = vertices.select(*own, have("part").alias("part"), have("ring").alias("ring"), "seq", "lon", "lat")
    arr = F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda s: F.struct(s["lon"].alias("x"), s["lat"].alias("y"))
    )
    return named.groupBy(*own, "part", "ring").agg(
        (F.col("ring") != 0).alias("hole"), arr.alias("vertices"), F.min("lon").alias("x1"), F.min("lat").alias("y1"), F.max("lon").alias("x2"), F.max("lat").alias("y2")
    )


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray-crossing parity as a fold over consecutive vertices."""
    last = F.element_at(ring, -1)

    def step(acc: Column, p: Column) -> Column:
        cross = (acc["y"] > y) != (p["y"] > y)
        at = S.div((p["x"] - acc["x"]) * (y - acc["y"]), p["y"] - acc["y"]) + acc["x"]
        flip = F.coalesce(cross & (x < at), F.lit(False))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), (acc["odd"] != flip).alias("odd"))

    start = F.struct(last["x"].alias("x"), last["y"].alias("y"), F.lit(False).alias("odd"))
    return F.aggregate(ring, start, step, lambda a: a["odd"])


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def points_in_polygons(
    points: DataFrame, vertices: DataFrame, point_id: str = "series_id", cell: float = 0.25, poly_keys: Sequence[str] = ("poly_id",)
) -> DataFrame:
    """``(point_id, poly_id)`` for every polygon that contains the point.

    Boxes of rings are spread over grid cells and met by the point's own cell; rings join afterwards,
    so their vertices are never copied per cell.  A point is inside if an odd number of
    the polygon's rings, over all its parts and holes, go around it.
    """
    shapes = rings(vertices, poly_keys)
    ring = [*[k for k in poly_keys if k not in ("part", "ring")], "part", "ring"]
    boxes = shapes.select(*ring, "x1", "y1", "x2", "y2").select(
        "*", F.explode(F.sequence(_cell(F.col("x1"), cell), _cell(F.col("x2"), cell))).alias("cx")
    ).select("*", F.explode(F.sequence(_cell(F.col("y1"), cell), _cell(F.col("y2"), cell))).alias("cy"))
    pts = points.select(
        F.col(point_id).alias("_pid"), F.col("lon").alias("_px"), F.col("lat").alias("_py"),
        _cell(F.col("lon"), cell).alias("cx"), _cell(F.col("lat"), cell).alias("cy"),
    )
    # Keys compress to few bytes but meet many times: a fixed number of parts, which adaptive execution does not merge.
    pts, boxes = finer(pts, "cx", "cy", times=1).distinct(), finer(boxes, "cx", "cy", times=1)
    near = pts.join(boxes, ["cx", "cy"]).where(in_box(F.col("_px"), F.col("_py"))).select("_pid", "_px", "_py", *ring)
    # A catchment that holds many points is spread over several parts.  Rings repeated per part are no small table,
    # although the planner, which does not see the repetition, would broadcast them.
    met = salted_join(near, shapes.select(*ring, "vertices").hint("merge"), ring, ["_pid"])
    around = met.where(ring_contains(F.col("vertices"), F.col("_px"), F.col("_py"))).groupBy("_pid", "_px", "_py", *poly_keys).agg(F.count("*").alias("_n"))
    return around.where("_n % 2 = 1").select(F.col("_pid").alias(point_id), *poly_keys).distinct()


# --- nesting -------------------------------------------------------------------------------------------


def nested_pairs(sites: DataFrame, vertices: DataFrame, cell: float = 0.25) -> DataFrame:
    """``(child, parent, child_area, parent_area)``: outlet inside a strictly larger catchment.

    ``sites`` is ``(series_id, lon, lat, area_km2)``; polygon ids are site ids.
    """
    hits = points_in_polygons(sites, vertices, cell=cell).where("series_id <> poly_id")
    area = sites.select("series_id", "area_km2")
    return (
        hits.select(F.col("series_id").alias("child"), F.col("poly_id").alias("parent"))
        .join(area.select(F.col("series_id").alias("child"), F.col("area_km2").alias("child_area")), "child")
        .join(area.select(F.col("series_id").alias("parent"), F.col("area_km2").alias("parent_area")), "parent")
        .where("parent_area > child_area")
        .select("child", "parent", "child_area", "parent_area")
    )


def nesting_depth(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Longest chain of parents above each site, 0 for sites without one.

    Round k keeps the children of round k - 1, so a site's depth is the last round it takes part
    in.  The number of rounds is the depth of the hierarchy; only the round's size reaches the
    driver.
    """
    edges = cut(pairs.select("child", "parent"))
    level = edges.select(F.col("child").alias("series_id")).distinct()
    found = sites.select("series_id", F.lit(0).alias("d"))
    k = 1
    while True:
        level = cut(level.select("series_id", F.lit(k).alias("d")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
        level = edges.join(level.select(F.col("series_id").alias("parent")), "parent", "left_semi").select(
            F.col("child").alias("series_id")
        ).distinct()
        k += 1
    return found.groupBy("series_id").agg(F.max("d").alias("depth"))


def nesting_summary(sites: DataFrame, pairs: DataFrame, depth: DataFrame) -> DataFrame:
    """Sites, nested sites, share, pairs and maximum depth in one row."""
    n = sites.agg(F.count("*").alias("n_sites"))
    p = pairs.agg(F.count_distinct("child").alias("n_nested"), F.count("*").alias("n_pairs"))
    d = depth.agg(F.max("depth").alias("max_depth"))
    # Three single-row tables.
    return n.join(F.broadcast(p)).join(F.broadcast(d)).withColumn("pct_nested", F.col("n_nested") / F.col("n_sites") * 100)


def immediate_parents(pairs: DataFrame) -> DataFrame:
    """Number of parents and the smallest one of each child."""
    return pairs.groupBy("child").agg(
        F.count("*").alias("n_parents"), F.min_by("parent", F.struct("parent_area", "parent")).alias("parent"),
        F.min("parent_area").alias("parent_area"),
    )


def nesting_chain(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, step, series_id)``: follow the smallest parent upwards from each start.

    Parents are strictly larger, so the walk ends; rounds equal the longest chain.
    """
    up = cut(immediate_parents(pairs).select(F.col("child").alias("series_id"), "parent"))
    at = cut(starts.select(F.col("series_id").alias("start"), F.lit(0).alias("step"), "series_id"))
    out, k = at, 1
    while True:
        at = cut(at.join(up, "series_id").select("start", F.lit(k).alias("step"), F.col("parent").alias("series_id")))
        if at.isEmpty():
            return out
        out, k = out.unionByName(at), k + 1


def nested_balance(pairs: DataFrame, daily: DataFrame, min_days: int = 2000) -> DataFrame:
    """Volume and area ratio of nested pairs over the days both series hold a value."""
    q = daily.where("value IS NOT NULL").select("series_id", "date", "value")
    up = q.select(F.col("series_id").alias("child"), "date", F.col("value").alias("qu"))
    down = q.select(F.col("series_id").alias("parent"), "date", F.col("value").alias("qd"))
    j = pairs.join(up, "child").join(down, ["parent", "date"])
    return j.groupBy("child", "parent").agg(
        F.count("*").alias("n_common"), S.div(F.max("parent_area"), F.max("child_area")).alias("area_ratio"),
        S.div_pos(F.sum("qd"), F.sum("qu")).alias("v_ratio"),
    ).where(F.col("n_common") >= min_days)


def ratio_strata(balance: DataFrame, bounds: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Pairs, share and violations per area-ratio band with an "All" row, through one rollup."""
    r = F.col("area_ratio")
    band = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(bounds[:-1], bounds[1:], labels))):
        band = F.when((r > lo) & (r <= hi), label).otherwise(band)
    bad = F.coalesce(F.col("v_ratio") <= 1, F.lit(False))
    tagged = balance.select(band.alias("band"), bad.alias("bad")).where("band IS NOT NULL")
    out = tagged.rollup("band").agg(F.count("*").alias("n_pairs"), F.count_if("bad").alias("n_violations"))
    total = F.max(F.when(F.col("band").isNull(), F.col("n_pairs"))).over(Window.partitionBy())
    return out.select(
        F.coalesce("band", F.lit("All")).alias("band"), "n_pairs", (F.col("n_pairs") / total * 100).alias("share_pct"),
        "n_violations", (F.col("n_violations") / F.col("n_pairs") * 100).alias("fail_pct"),
    )


# --- distances --------------------------------------------------------------------------------------------


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = FEATURE_RADIUS) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) ** 2
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _level_search(points: DataFrame, targets: DataFrame, tie: Sequence[str], distance: Column, size: float, reach, keys: Sequence[str] = (), open_at=None) -> DataFrame:
    """Best target of each distinct point, from fine to coarse cells.

    ``points (px, py, keys…)`` and ``targets (tx, ty, keys…, payload…)`` hold distinct places.  Cells
    grow fourfold from ``size / 64`` until they span the globe.  At each size a point meets the
    3 × 3 cells around it; an answer within ``reach(size)`` is final, as anything outside those cells is
    farther, and the last size keeps whatever it finds.  Crowded places are settled in fine cells and
    sparse ones in coarse cells.  ``open_at(size)`` tells which points still want coarser cells; only
    those go on, from a checkpoint, and the search ends when none is left.
    """
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    payload = [c for c in targets.columns if c not in keys]
    todo, out, size = points, None, size / 64
    while True:
        last = size >= 360
        p = todo.select("*", F.explode(around).alias("_i")).select("*", F.explode(around).alias("_j")).select(
            *points.columns, (_cell(F.col("px"), size) + F.col("_i")).alias("_cx"), (_cell(F.col("py"), size) + F.col("_j")).alias("_cy")
        )
        t = targets.select("*", _cell(F.col("tx"), size).alias("_cx"), _cell(F.col("ty"), size).alias("_cy"))
        j = p.join(t, ["_cx", "_cy", *keys]).withColumn("_d", distance)
        best = j.groupBy(*points.columns).agg(
            F.min_by(F.struct(*payload), F.struct("_d", *tie)).alias("_t"), F.min("_d").alias("_d")
        )
        done = cut(best if last else best.where(F.col("_d") <= reach(size)))
        out = done if out is None else out.unionByName(done)
        todo = todo.join(done.select(*points.columns), points.columns, "left_anti")
        todo = cut(todo.where(open_at(size)) if open_at else todo)
        if last or todo.isEmpty():
            break
        size *= 4
    return out.select(*points.columns, "_t.*", F.col("_d").alias("distance"))


def nearest_feature(points: DataFrame, features: DataFrame, tile: str = "tile", tile_degrees: float = 0.5) -> DataFrame:
    """Nearest feature of the point's tile by (distance, class area), however far it is.

    Points and features at the same place are searched once.  ``tile_degrees`` is the usual extent of a
    tile and sets the size of the cells, not how far the search goes.
    """
    area = F.lit(None).cast("int")
    for c, a in CLASS_AREA.items():
        area = F.when(F.col("river_class") == c, a).otherwise(area)
    f = features.select(tile, "feature_id", F.col("lon").alias("tx"), F.col("lat").alias("ty"), area.alias("approx_area"))
    f = f.groupBy(tile, "tx", "ty").agg(F.min(F.struct("approx_area", "feature_id")).alias("s")).select(tile, "tx", "ty", "s.*")
    places = points.join(f.select(tile).distinct(), tile, "left_semi").select(tile, F.col("lon").alias("px"), F.col("lat").alias("py")).distinct()
    d = haversine(F.col("px"), F.col("py"), F.col("tx"), F.col("ty"))
    # A step of one cell in longitude is shortest at the higher of the two latitudes.
    reach = lambda size: size * 111.19 * F.cos(F.radians(F.least(F.abs("py") + 2 * size, F.lit(89.0)))) * 0.999
    best = _level_search(places, f, ["approx_area", "feature_id"], d, tile_degrees, reach, [tile])
    return points.select("series_id", tile, F.col("lon").alias("px"), F.col("lat").alias("py")).join(best, [tile, "px", "py"]).select(
        "series_id", "feature_id", F.col("distance").alias("distance_km"), "approx_area"
    )


def match_sites(stations: DataFrame, sites: DataFrame, max_km: float = 25.0, area_ratio: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Nearest site of each station in degree space, kept when close and of similar area.

    A site within ``max_km`` lies within a number of degrees that grows with the station's latitude;
    a station goes on to coarser cells until they reach that far, so its nearest site is found wherever
    it can pass the distance test.  Stations and sites are ``(id, lon, lat, area_km2)``; an unknown
    area skips the area test.
    """
    degrees = max_km / 111.0
    s = sites.groupBy(F.col("lon").alias("tx"), F.col("lat").alias("ty")).agg(
        F.min(F.struct(F.col("id").alias("site_id"), F.col("area_km2").alias("site_area"))).alias("s")
    ).select("tx", "ty", "s.*")
    st = stations.select(F.col("id").alias("station_id"), F.col("lon").alias("px"), F.col("lat").alias("py"), F.col("area_km2").alias("station_area"))
    deg2 = (F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2
    # The parallel is shortest at the far end of the reach.
    widest = S.div(F.lit(degrees * 1.1), F.cos(F.radians(F.least(F.abs("py") + degrees, F.lit(90.0)))))
    open_at = lambda size: F.coalesce(widest, F.lit(360.0)) > size
    best = _level_search(st.select("px", "py").distinct(), s, ["site_id"], deg2, degrees * 1.1, lambda c: F.lit(c * c), open_at=open_at).drop("distance")
    near = st.join(best, ["px", "py"]).withColumn("distance_km", haversine(F.col("px"), F.col("py"), F.col("tx"), F.col("ty"), SITE_RADIUS))
    ratio = F.when((F.col("site_area") > 0) & (F.col("station_area") > 0), F.col("site_area") / F.col("station_area"))
    near = near.withColumn("area_ratio", ratio).where(F.col("distance_km") <= max_km)
    return near.where(F.col("area_ratio").isNull() | F.col("area_ratio").between(*area_ratio)).select(
        "station_id", "site_id", "distance_km", "area_ratio"
    )


def site_coordinates(stations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Coordinates of the wanted ids in their given order; a missing or invalid one is an error."""
    j = wanted.join(stations.select("series_id", "lon", "lat"), "series_id", "left")
    bad = F.col("lon").isNull() | F.col("lat").isNull() | ~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90)
    msg = F.concat(F.lit("no valid coordinates for "), F.col("series_id"))
    return j.select(
        *wanted.columns, *[F.when(bad, F.raise_error(msg)).otherwise(F.col(c)).cast("double").alias(c) for c in ("lon", "lat")]
    )


# --- hexagonal cells -----------------------------------------------------------------------------------------


def hex_cells(points: DataFrame, radius_km: float = 66.0) -> DataFrame:
    """Axial cell of each point ``(…, x, y)`` in metres: cube rounding half up, largest error repaired.

    On equal errors q is repaired first, then r.
    """
    if not radius_km > 0 or radius_km == float("inf"):
        raise ValueError("hex radius must be finite and positive")
    size = radius_km * 1000.0
    q = (F.sqrt(F.lit(3.0)) * F.col("x") / 3 - F.col("y") / 3) / size
    r = 2 * F.col("y") / (3 * size)
    base = points.select("*", q.alias("_q"), r.alias("_r"), (-q - r).alias("_s"))
    up = lambda c: F.floor(F.col(c) + 0.5)
    base = base.select("*", up("_q").alias("_a"), up("_r").alias("_b"), up("_s").alias("_c"))
    eq, er, es = (F.abs(F.col(a) - F.col(b)) for a, b in (("_a", "_q"), ("_b", "_r"), ("_c", "_s")))
    excess = F.col("_a") + F.col("_b") + F.col("_c")
    fix_q = (eq >= er) & (eq >= es)
    fix_r = ~fix_q & (er >= es)
    out = base.withColumn("q", F.col("_a") - F.when(fix_q, excess).otherwise(0)).withColumn(
        "r", F.col("_b") - F.when(fix_r, excess).otherwise(0)
    )
    return out.select(*points.columns, F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string")).alias("hex_id"), "q", "r")


def aggregate_hex(points: DataFrame, value: str, categories: Sequence[str] | None = None, radius_km: float = 66.0) -> DataFrame:
    """Per cell: rows, valid rows and the median, or the most frequent category (declared order on ties).

    Category cells count in two steps, so a crowded cell never gathers its rows.
    """
    if categories is not None and (not categories or len(set(categories)) != len(categories) or None in categories):
        raise ValueError("categories must be a non-empty list without repeats or nulls")
    cells = hex_cells(points, radius_km)
    k = ["hex_id", "q", "r"]
    if categories is None:
        from ..functions.quantiles import exact_quantiles

        bad = (float("nan"), float("inf"), float("-inf"))
        v = cells.withColumn("_v", F.when(~F.col(value).isin(*bad), F.col(value).cast("double")))
        n = v.groupBy(*k).agg(F.count("*").alias("n_total"), F.count("_v").alias("n_valid"))
        out = n.join(exact_quantiles(v, ["hex_id"], "_v", {"value": 0.5}), "hex_id", "left")
        return out.withColumn("n_missing", F.col("n_total") - F.col("n_valid"))
    order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(value))
    known = F.when(F.col(value).isNull() | F.col(value).isin(*categories), F.col(value)).otherwise(
        F.raise_error(F.concat(F.lit("undeclared category: "), F.col(value))).cast("string")
    )
    n = cells.withColumn(value, known).groupBy(*k, value).agg(F.count("*").alias("n"))
    has = F.col(value).isNotNull()
    best = F.when(has, F.struct(-F.col("n"), order))
    return n.groupBy(*k).agg(
        F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.min_by(value, best), F.lit(categories[0])).alias("value"), F.count_if(has).alias("n_categories"),
    )


def hex_export(points: DataFrame, value: str, id_col: str, path: str, categories: Sequence[str] | None = None, radius_km: float = 66.0) -> None:
    """Write membership and cells as JSON lines under one folder."""
    hex_cells(points, radius_km).select(id_col, "hex_id").write.mode("overwrite").json(f"{path}/membership")
    aggregate_hex(points, value, categories, radius_km).write.mode("overwrite").json(f"{path}/cells")
