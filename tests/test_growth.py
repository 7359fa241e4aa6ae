"""Work that has to grow no faster than its input: gridded means, station files, calendars, nesting."""

import datetime as dt
import math
import random
import tracemalloc

import numpy as np
import pytest

from freshet.operators import grid as GR
from freshet.operators import hierarchy as HI
from freshet.operators import spatial as SP
from freshet.sources import files as FI
from freshet.sources import release as RS


def grid_case(spark):
    """Records of 12 x 12 cells of a degree, some without a value, and weights of 30 small polygons and a wide one."""
    rnd = random.Random(5)
    days = [dt.date(2001, 1, 1) + dt.timedelta(i) for i in range(9)]
    field = [(float(la), float(lo), d, rnd.choice([None, rnd.uniform(-1, 5)]), rnd.uniform(-9, 9)) for la in range(12) for lo in range(12) for d in days if rnd.random() < 0.7]
    weights = [(f"p{p}", float(p % 11 + dy), float(p * 7 % 11 + dx), rnd.random()) for p in range(30) for dy in (0, 1) for dx in (0, 1)]
    weights += [("wide", float(la), 3.0, rnd.random()) for la in range(12)] + [("off", 99.0, 99.0, 1.0)]
    return (
        spark.createDataFrame(field, "lat double, lon double, date date, v double, prcp double"), spark.createDataFrame(weights, "poly_id string, lat double, lon double, w double"), field, weights
    )


@pytest.mark.parametrize("rows", [1 << 16, 9])
def test_gridded_means_by_block_equal_plain_sums(spark, monkeypatch, rows):
    monkeypatch.setattr(GR, "BLOCK_ROWS", rows)
    monkeypatch.setattr(GR, "STEP_ROWS", rows)
    f, w, field, weights = grid_case(spark)
    want: dict = {}
    for p, la, lo, x in weights:
        for a, b, d, v, t in field:
            if (a, b) == (la, lo):
                s = want.setdefault((p, d), [0.0, 0.0, 0.0, 0.0])
                s[0] += (v or 0.0) * x
                s[1] += x if v is not None else 0.0
                s[2] += t * x
                s[3] += x
    got = {(r["poly_id"], r["date"]): (r["v"], r["prcp"]) for r in GR.catchment_means(f, w, ["v", "prcp"]).collect()}
    assert got.keys() == want.keys() and any(p == "wide" for p, _ in got)
    for k, (a, b, c, d) in want.items():
        assert (got[k][0] is None) == (b == 0.0) and (b == 0.0 or math.isclose(got[k][0], a / b, abs_tol=1e-12)) and math.isclose(got[k][1], max(c / d, 0.0), abs_tol=1e-12)


def test_gridded_means_shuffle_no_row_per_cell_polygon_and_day(spark):
    f, w, _, _ = grid_case(spark)
    df = GR.catchment_means(f, w.where("poly_id <> 'wide'"), ["v", "prcp"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(poly_id" not in plan
    assert df.where("poly_id = 'off'").count() == 0 and GR.catchment_means(f.limit(0), w, ["v"]).count() == 0 and GR.catchment_means(f, w.limit(0), ["v"]).count() == 0


def test_station_files_are_shown_by_folder_of_a_task(spark, tmp_path):
    rows = [(s, dt.date(2001, 1, d), None if d == 3 else d + 0.0005, "RU" if s != "b/ 2" else None) for s in ("a", "b/ 2", "c") for d in (1, 3, 2)]
    df = spark.createDataFrame(rows, "series_id string, date date, value double, country string")
    FI.write_station_files(df, str(tmp_path / "in"))
    shown = sorted((tmp_path / "in").rglob("*"))
    folders = [p for p in shown if p.is_dir()]
    # Folders follow tasks, not series, and nothing hidden stays behind.
    assert all(p.name.startswith("part-") for p in folders) and len([p for p in shown if p.suffix == ".txt"]) == 3 and not any(p.name.startswith(".") for p in shown)
    texts = {p.name: p.read_text() for p in shown if p.is_file()}
    assert texts[next(n for n in texts if n.startswith("a-"))] == "# GRDC-No.: a\n# Country: RU\nYYYY-MM-DD;hh:mm; Value\n2001-01-01;--:--;1.001\n2001-01-02;--:--;2.001\n2001-01-03;--:--;-999.000\n"
    read = lambda: sorted((r.series_id, r.country, r.date.day, r.value) for r in spark.read.format("station_files").load(str(tmp_path / "in")).collect())
    assert read() == [(s, c, d, d + 0.001) for s, c in (("a", "RU"), ("b/ 2", None), ("c", "RU")) for d in (1, 2)]
    FI.write_station_files(df.where("series_id = 'c'"), str(tmp_path / "in"), mode="overwrite")
    assert read() == [("c", "RU", 1, 1.001), ("c", "RU", 2, 2.001)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        FI.write_station_files(df.withColumn("value", df.value / 0), str(tmp_path / "in"))
    assert read() == [("c", "RU", 1, 1.001), ("c", "RU", 2, 2.001)] and not any(p.name.startswith(".") for p in (tmp_path / "in").iterdir())


def test_complete_calendar_by_gaps_equals_plain_fill(spark):
    rnd = random.Random(3)
    start = dt.date(2001, 1, 1)
    days = [start + dt.timedelta(i) for i in range(-3, 15)]
    a = [(s, d, rnd.choice([None, float(i)])) for s in "abcd" for i, d in enumerate(days) if rnd.random() < (0.0 if s == "d" else 0.5)]
    a += [("early", days[0], 1.0), ("first", start, 2.0), ("last", start + dt.timedelta(11), 3.0), (None, start, 4.0), ("twice", days[5], 5.0), ("twice", days[5], 6.0)]
    b = [(s, d, float(-i)) for s in ("a", "d", "first", "only-b") for i, d in enumerate(days) if rnd.random() < 0.5]
    calendar = [start + dt.timedelta(i) for i in range(12)]
    want = []
    for s in {x[0] for x in a}:
        rows = []
        for d in calendar:
            pa, pb = ([v for k, e, v in t if k is not None and k == s and e == d] or [None] for t in (a, b))
            rows += [(d, x, y) for x in pa for y in pb]
        share = float(round(sum(x is not None for _, x, _ in rows) / len(rows) * 100))
        want += [(s, d, x, y, share) for d, x, y in rows]
    t = "series_id string, date date, value double"
    df = RS.complete_calendar(spark.createDataFrame(a, t), spark.createDataFrame(b, t), "2001-01-01", "2001-01-12")
    # The dense days come last: nothing is shuffled or sorted after them.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and not any(w in plan[: plan.index("Generate")] for w in ("Exchange", "Sort", "Join", "Window"))
    assert df.columns == ["series_id", "date", "p_a", "p_b", "availability"]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_points_meet_rings_without_a_broadcast_of_repeated_rings(spark):
    sites = spark.createDataFrame([(str(i), i % 10 * 0.1, i // 10 * 0.1, float(i)) for i in range(100)], "series_id string, lon double, lat double, area_km2 double")
    corners = [(-1, 0), (0, -1), (1, 0), (0, 1)]
    vertices = spark.createDataFrame([(str(i), s, i % 10 * 0.1 + 0.15 * x, i // 10 * 0.1 + 0.15 * y) for i in range(100) for s, (x, y) in enumerate(corners)], "poly_id string, seq int, lon double, lat double")
    df = SP.nested_pairs(sites, vertices)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any("Broadcast" in line and "_salt" in line for line in plan.splitlines()) and plan.count("REPARTITION_BY_NUM") == 2
    want = {(str(a), str(b)) for a in range(100) for b in range(a + 1, 100) if abs(a % 10 - b % 10) + abs(a // 10 - b // 10) == 1}
    assert {(r["child"], r["parent"]) for r in df.collect()} == want


def test_assigning_vectors_holds_few_distances():
    rng = np.random.default_rng(1)
    centres, x = rng.normal(size=(HI.LEAVES, 8)), rng.normal(size=(HI.ROWS, 8))
    norms = (centres**2).sum(axis=1)
    tracemalloc.start()
    own = HI.nearest(x, centres, norms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    assert (own[:50] == ((x[:50, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
