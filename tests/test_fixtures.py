"""Known-answer cases on small hand-made series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import runs as R
from freshet.operators import attributes as AT
from freshet.operators import filters as FL
from freshet.operators import grid as GR
from freshet.operators import ingest as IN
from freshet.operators import meteo as M
from freshet.operators import quality as Q
from freshet.operators import relations as RL
from freshet.operators import response as MR
from freshet.operators import signatures as S
from freshet.operators import spatial as SP
from freshet.operators import validation as VA
from freshet.sources import release as RS


def days(start, n):
    d = dt.date.fromisoformat(start)
    return [d + dt.timedelta(i) for i in range(n)]


def series(spark, dates, values, **more):
    rows = [("s", d, None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)) for d, v in zip(dates, values)]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def durations(spark, dates, mask):
    df = spark.createDataFrame([("s", d, bool(m)) for d, m in zip(dates, mask)], "series_id string, date date, m boolean")
    e = R.event_table(df, F.col("m"))
    return [r["n_rows"] for r in e.orderBy("start").collect()]


@pytest.mark.parametrize(
    "on, want", [({5, 6, 7, 12}, [3, 1]), ({0, 1}, [2]), ({17, 18, 19}, [3]), (set(range(20)), [20]), (set(), [])]
)
def test_event_durations(spark, on, want):
    d = days("2020-01-01", 20)
    assert durations(spark, d, [i in on for i in range(20)]) == want


def test_event_durations_break_at_date_gaps(spark):
    assert durations(spark, days("2020-01-10", 3) + days("2020-02-10", 3), [True] * 6) == [3, 3]
    assert durations(spark, [dt.date(2020, 3, d) for d in (1, 2, 4, 5)], [True] * 4) == [2, 2]


def edges(spark, present, filled):
    n = len(present)
    df = spark.createDataFrame(list(zip(["s"] * n, days("2020-01-01", n), present, filled)), "series_id string, date date, present boolean, filled boolean")
    return [i for i, r in enumerate(IN.edge_fills(df).orderBy("date").collect()) if r["edge"]]


def test_edge_fills(spark):
    filled = [i in (2, 3, 5, 6, 9) for i in range(11)]
    present = [i not in (7, 8) for i in range(11)]
    # Run 2-3 is bridged; 5-6 ends at an absent day; 9 follows an absent day.
    assert edges(spark, present, filled) == [5, 6, 9]
    assert edges(spark, [True] * 3, [True, False, True]) == [0, 2]


def test_short_gaps_only(spark):
    v = [None if i in (2, 3, 4) or 8 <= i <= 15 else i for i in range(20)]
    out = IN.fill_short_gaps(series(spark, days("2020-01-01", 20), v)).orderBy("date").collect()
    for i, r in enumerate(out):
        if 8 <= i <= 15:
            assert r["value"] is None and not r["was_filled"]
        else:
            assert r["value"] == pytest.approx(i)
            assert r["was_filled"] == (i in (2, 3, 4))


def test_spline_reproduces_a_parabola(spark):
    v = [None if i in (5, 6, 20) else 0.5 * i * i - 3 * i + 2 for i in range(40)]
    out = IN.fill_short_gaps(series(spark, days("2020-01-01", 40), v)).orderBy("date").collect()
    assert [r["value"] for r in out] == pytest.approx([0.5 * i * i - 3 * i + 2 for i in range(40)])


def test_record_edges_stay_null(spark):
    v = [None, None, 1, 2, 3, 4, None]
    out = [r["value"] for r in IN.fill_short_gaps(series(spark, days("2020-01-01", 7), v)).orderBy("date").collect()]
    assert out[0] is None and out[1] is None and out[6] is None


def test_quality_codes(spark):
    rows = [(True, False), (True, True), (True, False), (False, False), (True, True), (False, True)]
    df = spark.createDataFrame(rows, "p boolean, f boolean")
    got = [r[0] for r in df.select(IN.quality_codes(F.col("p"), F.col("f"))).collect()]
    assert got == [0, 1, 0, 3, 1, 3]


def test_valid_years_of_partial_record(spark):
    d = days("2008-10-01", 5478)
    v = [None if x < dt.date(2016, 8, 1) else 1.0 for x in d]
    out = S.series_signatures(series(spark, d, v)).first()
    assert out["n_valid_periods"] == 7
    assert out["mean_discharge"] == pytest.approx(1.0)


def pq(spark, n=365, hole=None):
    rng = np.random.default_rng(3)
    p = rng.gamma(0.5, 4.0, n + 3)
    q = np.concatenate([[0, 0, 0], p[:-3]]) + rng.normal(0, 0.05, n + 3)
    d = days("2010-01-01", n)
    rows = [("s", x, float(p[i]), None if hole and hole[0] <= x <= hole[1] else float(q[i])) for i, x in enumerate(d)]
    return spark.createDataFrame(rows, "series_id string, date date, p double, value double")


def test_lag_of_three_days(spark):
    full = MR.cross_correlation(pq(spark)).first()
    holed = MR.cross_correlation(pq(spark, hole=(dt.date(2010, 4, 10), dt.date(2010, 5, 20)))).first()
    assert full["optimal_lag_days"] == holed["optimal_lag_days"] == 3
    assert abs(full["max_cross_correlation"] - holed["max_cross_correlation"]) < 0.05
    assert MR.cross_correlation(pq(spark, n=20)).count() == 0


@pytest.mark.parametrize("months, flagged", [((12, 1, 2), False), ((6, 7), True)])
def test_constant_runs_and_the_ice_season(spark, months, flagged):
    rng = np.random.default_rng(1)
    d = days("2010-10-01", 365)
    v = [3.0 if x.month in months else 10 + rng.normal() for x in d]
    f = Q.anomaly_flags(series(spark, d, v)).first()["flags"]
    assert ("constant_value" in f) == flagged


def test_constant_series_do_not_raise(spark):
    df = series(spark, days("2010-10-01", 800), [4.0] * 800)
    assert S.autocorrelation(df).first()["lag1_autocorr"] == 0.0
    assert Q.year_deviation(df).first()["correlation"] is None


def test_weighted_attributes(spark):
    df = spark.createDataFrame([("c", 40.0, 100.0, 10.0), ("c", 20.0, 50.0, 30.0)], "series_id string, overlap_km2 double, x1 double, x2 double")
    r = AT.area_weighted(df, ["x1", "x2"]).first()
    assert r["x1"] == pytest.approx((40 * 100 + 20 * 50) / 60)
    df = spark.createDataFrame([("c", 40.0, 100.0, None), ("c", 20.0, 50.0, 30.0)], "series_id string, overlap_km2 double, x1 double, x2 double")
    assert AT.area_weighted(df, ["x2"]).first()["x2"] == pytest.approx(30.0)
    none = df.withColumn("x2", F.lit(None).cast("double"))
    assert AT.area_weighted(none, ["x2"]).first()["x2"] is None


CLIMATES = {
    "Dfb": ([-12, -10, -4, 5, 12, 17, 19, 17, 11, 4, -3, -9], [45] * 12),
    "Dfd": ([-45, -40, -28, -12, 2, 12, 15, 11, 2, -14, -33, -42], [20] * 12),
    "BSk": ([-8, -6, 2, 11, 17, 22, 25, 23, 16, 8, 0, -6], [22] * 12),
    "Dwc": ([-24, -20, -11, -1, 7, 14, 16, 13, 6, -4, -16, -22], [3, 3, 5, 12, 30, 60, 90, 80, 45, 15, 8, 4]),
    "ET": ([-28, -28, -25, -17, -7, 1, 6, 6, 1, -9, -18, -24], [20] * 12),
    "Cfa": ([4, 5, 8, 12, 17, 21, 24, 24, 20, 15, 10, 6], [110] * 12),
}


def test_climate_classes(spark):
    rows = [(c, m + 1, float(t[m]), float(p[m])) for c, (t, p) in CLIMATES.items() for m in range(12)]
    rows += [("none", m + 1, None, 10.0) for m in range(12)]
    df = spark.createDataFrame(rows, "series_id string, month int, t double, p double")
    got = {r["series_id"]: r["climate_class"] for r in M.climate_class(df).collect()}
    assert got == {**{c: c for c in CLIMATES}, "none": ""}


def test_hourly_to_daily(spark):
    t0 = dt.datetime(2020, 1, 1)
    temps = list(np.linspace(-5, 5, 24)) + list(np.linspace(0, 10, 24))
    rows = [("s", t0 + dt.timedelta(hours=i), float(v + 273.15)) for i, v in enumerate(temps)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, value double")
    a, b = IN.hourly_to_daily(df).orderBy("date").collect()
    assert (a["t_mean"], b["t_mean"]) == (pytest.approx(0, abs=1e-9), pytest.approx(5))
    assert a["t_min"] == pytest.approx(-5) and b["t_max"] == pytest.approx(10)


HEX = [("a", 0.0, 0.0, 1.0, "A"), ("b", 1000.0, 500.0, 3.0, "B"), ("c", -900.0, 100.0, None, None), ("d", 400.0, -700.0, float("inf"), "B"), ("e", 10.0, 10.0, 2.0, "A")]


def test_hex_cells(spark):
    df = spark.createDataFrame(HEX, "id string, x double, y double, v double, grade string")
    r = SP.aggregate_hex(df, "v").first()
    assert (r["hex_id"], r["n_total"], r["n_valid"], r["n_missing"], r["value"]) == ("0:0", 5, 3, 2, 2.0)
    c = SP.aggregate_hex(df, "grade", categories=["A", "B"]).first()
    assert (c["value"], c["n_categories"], c["n_missing"]) == ("A", 2, 1)
    assert SP.aggregate_hex(df, "grade", categories=["B", "A"]).first()["value"] == "B"


def test_hex_boundaries_ignore_row_order(spark):
    size = 66_000.0
    pts = [(str(i), math.sqrt(3) * size * (i - 5) / 2, 0.75 * size * (i % 3)) for i in range(11)]
    cells = lambda rows: {r["id"]: r["hex_id"] for r in SP.hex_cells(spark.createDataFrame(rows, "id string, x double, y double")).collect()}
    assert cells(pts) == cells(pts[::-1])


def test_hex_rejects_bad_input(spark):
    df = spark.createDataFrame(HEX, "id string, x double, y double, v double, grade string")
    with pytest.raises(ValueError):
        SP.hex_cells(df, radius_km=0.0)
    with pytest.raises(ValueError):
        SP.aggregate_hex(df, "grade", categories=["A", "A"])
    with pytest.raises(Exception, match="undeclared category"):
        SP.aggregate_hex(df, "grade", categories=["A"]).collect()


def test_covered_months_ignore_null_months(spark):
    rows = []
    for i in ("1", "2", "3"):
        rows += [(i, d, 1.0) for d in days("2022-01-01", 59)] + [(i, d, None) for d in days("2023-01-01", 31)]
    df = spark.createDataFrame(rows, "series_id string, date date, value double")
    got = sorted(str(r["month"]) for r in IN.covered_months(df).collect())
    assert got == ["2022-01-01", "2022-02-01"]


def box_vertices(spark, x1=0.95, y1=0.95, x2=1.05, y2=1.05):
    return spark.createDataFrame(
        [("p", 1, 0, x1, y1), ("p", 1, 1, x2, y1), ("p", 1, 2, x2, y2), ("p", 1, 3, x1, y2)], "poly_id string, part int, seq int, lon double, lat double"
    )


def cells(spark, nx, ny):
    return spark.createDataFrame([(0.9 + 0.1 * j, 0.9 + 0.1 * i) for i in range(nx) for j in range(ny)], "lat double, lon double")


def test_weights_follow_the_grid(spark):
    v = box_vertices(spark)
    small, large = cells(spark, 3, 3), cells(spark, 4, 3)
    stored = GR.cells_in_extent(v, small, 0.1)
    assert GR.stale_polygons(stored, v, small, 0.1).count() == 0
    part = small.where("lon < 1.05")
    assert GR.stale_polygons(GR.cells_in_extent(v, part, 0.1), v, large, 0.1).count() == 1
    w = GR.fractional_weights(v, small, 0.1).collect()
    assert sum(r["w"] for r in w) == pytest.approx(1.0)
    assert max(r["w"] for r in w) == pytest.approx(1.0, abs=1e-6)


def test_triangle_weights_match_sampling(spark):
    v = spark.createDataFrame([("p", 1, 0, 0.87, 0.87), ("p", 1, 1, 1.19, 0.93), ("p", 1, 2, 0.98, 1.17)], "poly_id string, part int, seq int, lon double, lat double")
    got = {(round(r["lat"], 1), round(r["lon"], 1)): r["w"] for r in GR.fractional_weights(v, cells(spark, 4, 4), 0.1).collect()}
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0.8, 1.2, 400_000), rng.uniform(0.8, 1.2, 400_000)
    inside = np.ones_like(x, bool)
    pts = [(0.87, 0.87), (1.19, 0.93), (0.98, 1.17)]
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    for (lat, lon), w in got.items():
        share = (inside & (np.abs(x - lon) <= 0.05) & (np.abs(y - lat) <= 0.05)).sum() / inside.sum()
        assert w == pytest.approx(share, abs=0.004)


def test_filled_source_needs_a_note(spark):
    raw = spark.createDataFrame([("1", dt.date(2020, 1, 1), 1.0), ("2", dt.date(2020, 1, 1), 1.0)], "series_id string, date date, v double")
    filled = raw.withColumn("v", F.lit(9.0))
    notes = spark.createDataFrame([("1", "filled")], "series_id string, note string")
    got = {r["series_id"]: r["v"] for r in RS.choose_source(raw, filled, notes, ["v"]).collect()}
    assert got == {"1": 9.0, "2": 1.0}


def test_unit_factors():
    assert GR.unit_factor("et", "mm") == 1.0
    assert GR.unit_factor("prcp", "m") == 1000.0
    assert GR.unit_factor("t_mean", "m") == 1.0


def test_rank_correlation_interval(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=200)
    y = x + rng.normal(size=200)
    rows = [("noisy", float(a), float(b)) for a, b in zip(x, y)] + [("mono", float(i), float(i * i)) for i in range(100)] + [("noisy", None, 1.0)] * 5
    df = spark.createDataFrame(rows, "g string, x double, y double")
    one = {r["g"]: r for r in RL.boot_spearman_ci(df, ["g"], "x", "y", n_boot=40).collect()}
    two = {r["g"]: r for r in RL.boot_spearman_ci(df.repartition(5), ["g"], "x", "y", n_boot=40).collect()}
    for g in one:
        assert [one[g][c] for c in ("rho", "ci_lo", "ci_hi")] == pytest.approx([two[g][c] for c in ("rho", "ci_lo", "ci_hi")])
    assert one["noisy"]["n_pairs"] == 200
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert one["noisy"]["rho"] == pytest.approx(want)
    assert one["noisy"]["ci_lo"] < want < one["noisy"]["ci_hi"]
    assert (one["mono"]["ci_lo"], one["mono"]["ci_hi"]) == (pytest.approx(1.0), pytest.approx(1.0))


def test_ids_stay_text_and_must_be_unique(spark):
    ok = spark.createDataFrame([("00002",), ("1000001",), ("001",)], "series_id string")
    assert [r[0] for r in RS.require_ids(ok).collect()] == ["00002", "1000001", "001"]
    assert FL.in_scope(ok).count() == 2
    for bad in ([("1",), ("1",)], [("",)], [(None,)]):
        with pytest.raises(ValueError):
            RS.require_ids(spark.createDataFrame(bad, "series_id string"))


def test_id_alias():
    assert VA.find_id_column(["Gauge-ID", "x"]) == "Gauge-ID"
    for cols in (["x"], ["gauge_id", "site_id"]):
        with pytest.raises(ValueError):
            VA.find_id_column(cols)


def test_cell_text(spark):
    raw = ["прсх", "прмз", "1,5", "-3", "  ", "abc", "1.2.3", "7-", None]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    got = [r[0] for r in df.select(IN.cell_value(IN.clean_cell(F.col("t")))).collect()]
    assert got == [0.0, 0.0, 1.5, 3.0, -9999.0, -9999.0, None, 7.0, -9999.0]


def test_leap_day_and_dots(spark):
    head = ["m%d" % i for i in range(1, 13)]
    rows = []
    for d in range(1, 32):
        cells_ = ["5"] * 12
        cells_[1] = "" if d == 29 else "4"
        cells_[2] = "." if d in (1, 15) else str(d)
        rows.append(("f", 0, "s", 2020, d, *cells_))
    df = spark.createDataFrame(rows, "file string, block int, series_id string, year int, day int, " + ", ".join(f"{h} string" for h in head))
    got = {r["date"]: r["value"] for r in IN.daily_from_blocks(df).collect()}
    assert len(got) == 366
    assert got[dt.date(2020, 2, 29)] == 4.0
    assert got[dt.date(2020, 3, 15)] == 15.0
    assert got[dt.date(2020, 3, 1)] == 2.0


def test_missing_coordinates_raise(spark):
    st = spark.createDataFrame([("1", 30.0, 60.0)], "series_id string, lon double, lat double")
    want = spark.createDataFrame([("1",), ("2",)], "series_id string")
    with pytest.raises(Exception, match="no valid coordinates for 2"):
        SP.site_coordinates(st, want).collect()


SQUARE = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))
EAST, NORTH = 20.0, 10.0  # away from the pole of the area formula


def parted(spark):
    """Two unit squares with a gap; the first has a hole in its middle."""
    rows = [("p", 1, 0, i, x, y) for i, (x, y) in enumerate(SQUARE)] + [("p", 1, 1, i, 0.4 + 0.2 * x, 0.4 + 0.2 * y) for i, (x, y) in enumerate(SQUARE)]
    rows += [("p", 2, 0, i, 3 + x, y) for i, (x, y) in enumerate(SQUARE)]
    rows = [(*r[:4], EAST + r[4], NORTH + r[5]) for r in rows]
    return spark.createDataFrame(rows, "poly_id string, part int, ring int, seq int, lon double, lat double")


def test_parts_and_holes(spark):
    v = parted(spark)
    pts = [("in1", 0.2, 0.3), ("hole", 0.5, 0.5), ("gap", 2.0, 0.5), ("in2", 3.5, 0.5), ("out", 5.0, 0.5)]
    pts = [(i, EAST + x, NORTH + y) for i, x, y in pts]
    got = SP.points_in_polygons(spark.createDataFrame(pts, "series_id string, lon double, lat double"), v)
    assert {r["series_id"] for r in got.collect()} == {"in1", "in2"}
    area = {r["part"]: r["area_km2"] for r in SP.polygon_areas(v).collect()}
    assert area[1] / area[2] == pytest.approx(0.96, rel=2e-2)
    grid = spark.createDataFrame([(NORTH + 0.1 + 0.2 * j, EAST + 0.1 + 0.2 * i) for i in range(25) for j in range(5)], "lat double, lon double")
    w = {(round(r["lon"] - EAST, 1), round(r["lat"] - NORTH, 1)): r["w"] for r in GR.fractional_weights(v, grid, 0.2).collect()}
    assert sum(w.values()) == pytest.approx(1.0) and len(w) == 49
    assert (0.5, 0.5) not in w and not any(1.0 < x < 3.0 for x, _ in w)
    assert w[(0.1, 0.1)] == pytest.approx(1 / 49, rel=2e-2)


def test_matches_near_the_pole_and_far_features(spark):
    st = spark.createDataFrame([("a", 10.0, 85.0, None), ("b", 10.0, 20.0, None), ("c", 0.0, 90.0, None)], "id string, lon double, lat double, area_km2 double")
    sites = spark.createDataFrame([("s", 12.2, 85.0, None), ("t", 12.2, 20.0, None)], "id string, lon double, lat double, area_km2 double")
    got = SP.match_sites(st, sites).collect()
    assert [(r["station_id"], r["site_id"]) for r in got] == [("a", "s")] and got[0]["distance_km"] == pytest.approx(21.3, abs=0.2)
    pts = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 1, 0.1, 0.1), ("c", 2, 0.0, 0.0)], "series_id string, tile int, lon double, lat double")
    feats = spark.createDataFrame([(1, "f", 2.0, 0.0, "rivers"), (1, "g", -9.0, 0.0, "rivers")], "tile int, feature_id string, lon double, lat double, river_class string")
    assert {(r["series_id"], r["feature_id"]) for r in SP.nearest_feature(pts, feats).collect()} == {("a", "f"), ("b", "f")}


def test_distributions_converge():
    from freshet.functions import distributions as D

    a = np.array([1e3, 1e4, 9.9e4, 1.1e5, 1e6, 1e8])
    assert D.inc_gamma(a, a) == pytest.approx(0.5 + 1 / (3 * np.sqrt(2 * np.pi * a)), abs=1e-6)
    for skew in (1e-6, 1e-3, 1e-2, 0.1):
        shape = 4 / skew**2
        assert float(D.inc_gamma(shape, shape)) == pytest.approx(0.5 + 1 / (3 * np.sqrt(2 * np.pi * shape)), abs=1e-5)
    assert float(D.inc_beta(2e5, 2e5, 0.5)) == pytest.approx(0.5)
