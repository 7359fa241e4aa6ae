"""Queries against their SQL on tables where ties, empty fills and distant latitudes occur."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import ingest as IN
from freshet.operators import meteo as M
from freshet.operators import overlay as OL
from freshet.operators import quality as Q
from freshet.plans import load

from tests.oracle_check import TABLES, compare, connect

SMALL = "/root/testdata/sf0.001"


def tables(folder, **changed):
    """A folder of the small tables, some of them replaced by a selection."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for t in TABLES:
        con.execute(f"COPY ({changed.get(t, f'FROM {t}')}) TO '{folder}/{t}.parquet'")
    return str(folder)


def agree(spark, sf, name):
    return compare(spark, connect(sf), load()[name], sf)[0]


def test_no_fill_has_no_note(spark, tmp_path):
    sf = tables(tmp_path, lineitem="SELECT * REPLACE (0.05 AS l_discount) FROM lineitem")
    rows = load()["ing_fill_counts"].build(spark, sf).collect()
    assert rows and all(r["note"] is None and r["n_gappy"] == r["n_p_b"] == 0 for r in rows)
    want = connect(sf).execute(load()["ing_fill_counts"].sql).fetchall()
    assert sorted(want) == sorted((r["series_id"], 0, 0, None) for r in rows)


def test_equal_spreads_share_a_rank(spark, tmp_path):
    """Every quantity twice, in another order of days: spreads are equal, however they are added up."""
    r = np.random.default_rng(2)
    rows = []
    for pair in range(150):
        v = r.integers(1, 50, 25)
        for twin in (0, 1):
            rows += [(2 * pair + twin, int(d), float(q)) for d, q in enumerate(r.permutation(v) if twin else v)]
    con = duckdb.connect()
    con.execute("CREATE TABLE made (k BIGINT, d INTEGER, q DOUBLE)")
    con.executemany("INSERT INTO made VALUES (?, ?, ?)", rows)
    con.execute(f"COPY made TO '{tmp_path}/made.parquet'")
    (tmp_path / "sf").mkdir()
    sf = tables(
        tmp_path / "sf",
        lineitem=f"SELECT l.* REPLACE (k AS l_suppkey, q AS l_quantity, TIMESTAMP '1995-01-01' + to_days(d) AS l_shipdate) FROM '{tmp_path}/made.parquet', (SELECT * FROM lineitem LIMIT 1) l ORDER BY hash(k, d)",
        supplier="SELECT s.* REPLACE (i AS s_suppkey, 37 * i % 9000 AS s_acctbal) FROM range(300) t(i), (SELECT * FROM supplier LIMIT 1) s")
    by = np.array([[q for k, _, q in rows if k == i] for i in range(300)])
    n = by.shape[1]
    mean, spread = by.sum(axis=1), n * (by**2).sum(axis=1) - by.sum(axis=1) ** 2
    ranks = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    want = np.corrcoef(ranks(mean), ranks(spread))[0, 1]
    assert load()["rel_spearman_network"].build(spark, sf).first()["rho"] == pytest.approx(want, abs=1e-6)
    assert agree(spark, sf, "rel_spearman_network") is None
    assert {r["subset"]: r["rho"] for r in load()["rel_subset_spearman"].build(spark, sf).collect()}["all"] == pytest.approx(want, abs=1e-6)
    assert agree(spark, sf, "rel_subset_spearman") is None


def test_climate_class_does_not_depend_on_the_order_of_months(spark):
    """Equal sums of both halves are a tie, in whatever order the months are added."""
    r = np.random.default_rng(4)
    half, rows = [0.1, 150.7, 33.3, 41.9, 77.7, 20.3], []
    for i in range(300):
        p = np.concatenate([r.permutation(half), r.permutation(half)])
        months = [4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 2, 3]
        rows += [(str(i), m, 12.0 if k < 6 else -2.0, float(p[k])) for k, m in enumerate(months)]
    df = spark.createDataFrame(rows, "series_id string, month int, t double, p double")
    assert {x["climate_class"] for x in M.climate_class(df).collect()} == {"Dwb"}


def test_areas_of_many_pairs_at_once():
    r = np.random.default_rng(8)
    star = lambda n, x, y, d: np.stack([x + (w := d * (1 - 0.6 * r.random(n))) * np.cos(t := np.arange(n) * 2 * np.pi / n), y + w * np.sin(t)], axis=1)
    pairs = [([star(int(r.integers(3, 40)), *r.uniform(0, 3, 2), 1.5) for _ in range(int(r.integers(0, 3)))] for _ in range(2)) for _ in range(300)]
    pairs = [(list(a), list(b)) for a, b in pairs]
    pairs += [([np.array([(0, 0), (1, 0), (1, 1), (0, 1.0)])], [np.array([(x, 0), (x + 1, 0), (x + 1, 1), (x, 1.0)])]) for x in (0, 0.5, 1, 2)]
    edges = [[OL._edges(s) for s in side] for side in zip(*pairs)]
    flat = [v for side in edges for v in (np.concatenate(side), np.array([len(e) for e in side]))]
    got = OL.overlap_areas(*flat)
    assert got == pytest.approx([OL.overlap_area(a, b) for a, b in pairs], rel=1e-9, abs=1e-12)
    assert (got > 0).sum() > 100 and list(got[-4:]) == pytest.approx([1, 0.5, 0, 0])


def test_polygons_beyond_a_pole_do_not_fold_back(spark):
    box = lambda name, y: [(name, 1, 0, i, 10.0 + dx, y + dy) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    table = lambda rows: spark.createDataFrame([(n, p, r, i, float(x), float(y)) for n, p, r, i, x, y in rows], "poly_id string, part int, ring int, seq int, lon double, lat double")
    got = OL.overlaps(table(box("a", 60) + box("far", 100)), table(box("same", 60.5) + box("mirror", 119.2) + box("near", 79.5))).collect()
    assert {(r["a_id"], r["b_id"]) for r in got} == {("a", "same")}


def test_rows_without_a_neighbour_make_no_group(spark):
    """Only rows of runs of two and more reach the aggregation, however many others there are."""
    rows = [("a", f"2000-01-{d:02d}", float(v)) for d, v in enumerate([1, 2, 2, 3, 4, 4, 4, 5, 1, 1], 1)] + [("b", "2000-01-01", 7.0), ("c", "2000-01-01", 7.0), ("c", "2000-02-01", 7.0)]
    df = spark.createDataFrame(rows, "series_id string, date string, value double").withColumn("date", F.to_date("date"))
    runs = Q.constant_runs(df, min_days=2)
    got = sorted((r["series_id"], str(r["start"]), r["n_days"], r["run_value"]) for r in runs.collect())
    assert got == [("a", "2000-01-02", 2, 2.0), ("a", "2000-01-05", 3, 4.0), ("a", "2000-01-09", 2, 1.0), ("c", "2000-01-01", 2, 7.0)]
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):]
    assert below.index("Filter") < below.index("lead(")


def test_calendars_are_sorted_in_small_parts(spark):
    """A dense calendar is many times longer than its input, so it takes more tasks than the session's shuffles."""
    rows = [(str(k), f"20{y:02d}-01-01", float(10 + 30 * (y % 2)), 1) for k in range(40) for y in range(3)]
    d = IN.merge_fragments(spark.createDataFrame(rows, "series_id string, date string, value double, file int").withColumn("date", F.to_date("date")))
    edges = IN.edge_fills(d.select("series_id", "date", F.col("value").isNotNull().alias("present"), F.coalesce(F.col("value") < 30, F.lit(False)).alias("filled")))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = edges.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert edges.count() == 40 * 732 and edges.where("edge").count() == 80
    assert d.rdd.getNumPartitions() == edges.rdd.getNumPartitions() == parts and len(sizes) > parts / 4
