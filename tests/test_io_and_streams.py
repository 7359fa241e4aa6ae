"""File layouts, manifests and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from freshet.operators import response as MR
from freshet.operators import spatial as SP
from freshet.operators import validation as VA
from freshet.sources import files as FI
from freshet.streaming import streams as ST


def daily(spark, ids=("01", "2"), n=70):
    rows = [(i, dt.date(2021, 1, 1) + dt.timedelta(k), float(k % 9)) for i in ids for k in range(n)]
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def test_series_folder(spark, tmp_path):
    (tmp_path / "007.csv").write_text("date,q_cms,x\n2020-01-01,1.5,9\n2020-01-02,,9\n2020-01-03,nan,9\n")
    (tmp_path / "8.csv").write_text("x,date,q_cms\n1,2020-01-01,2\n")
    (tmp_path / "9.csv").write_text("date,other\n2020-01-01,2\n")
    got = {(r["series_id"], str(r["date"])): r["value"] for r in FI.read_series_folder(spark, str(tmp_path), "q_cms").collect()}
    assert got == {("007", "2020-01-01"): 1.5, ("007", "2020-01-02"): None, ("007", "2020-01-03"): None, ("8", "2020-01-01"): 2.0}


def test_attributes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("series_id,x,y\n001,1,2\n02,3,\n")
    ids = spark.createDataFrame([("001",)], "series_id string")
    r = FI.read_attributes(spark, str(tmp_path / "a.csv"), ids).collect()
    assert [(x["series_id"], x["x"], x["y"]) for x in r] == [("001", 1.0, 2.0)]


def test_months_are_kept_unless_overwritten(spark, tmp_path):
    path = str(tmp_path / "m")
    FI.write_months(daily(spark), path)
    FI.write_months(daily(spark, n=100).withColumn("value", F.lit(-1.0)), path)
    got = {(r["month"], r["value"] == -1.0) for r in spark.read.parquet(path).select("month", "value").distinct().collect()}
    assert (4, True) in got and (1, True) not in got
    FI.write_months(daily(spark, n=31).withColumn("value", F.lit(-2.0)), path, overwrite=True)
    back = spark.read.parquet(path)
    assert back.where("month = 1").agg(F.max("value")).first()[0] == -2.0
    assert back.where("month = 2").count() == 56


def test_bucketed_and_graded_layouts(spark, tmp_path):
    d = daily(spark)
    FI.write_series(d, str(tmp_path / "s"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "s")).drop("series_bucket").exceptAll(d).count() == 0
    g = spark.createDataFrame([("01", "A")], "series_id string, overall_grade string")
    FI.write_by_grade(d, g, str(tmp_path / "g"))
    a = FI.read_by_grade(spark, str(tmp_path / "g"), ["A"], ["value", "absent"])
    assert a.count() == 70 and {r[0] for r in a.select("series_id").distinct().collect()} == {"01"}
    assert FI.read_by_grade(spark, str(tmp_path / "g"), ["ungraded"]).count() == 70


def test_manifest(spark, tmp_path):
    for n in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / n).write_text(n)
    have = FI.file_digests(spark, str(tmp_path))
    listed = have.where("path <> 'c.txt'").withColumn("digest", F.when(F.col("path") == "b.txt", "x").otherwise(F.col("digest")))
    listed = listed.union(spark.createDataFrame([("d.txt", "y")], "path string, digest string"))
    got = {r["path"]: r["status"] for r in VA.manifest_check(have, listed).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "unlisted", "d.txt": "missing"}


def test_metric_gate_and_schema(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("x", 1.0), ("z", 2.0)], "metric string, value double")
    c = VA.metric_check(a, b)
    assert VA.check_gate(c).first() == (1, 2)
    with pytest.raises(ValueError, match="y, z"):
        VA.require(c)
    VA.require(VA.metric_check(a, a))
    assert VA.schema_diff(a, a.withColumn("metric", F.lit(1))).count() == 1
    m = VA.with_metadata(a, {"value": {"units": "mm", "long_name": "v", "source": "s"}})
    assert {r["column"]: r["missing"] for r in VA.column_metadata(m).collect()}["value"] == ""


def test_hex_export(spark, tmp_path):
    p = spark.createDataFrame([("a", 0.0, 0.0, 1.0)], "id string, x double, y double, v double")
    SP.hex_export(p, "v", "id", str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h/cells")).first()["hex_id"] == "0:0"
    lines = [f.read_text() for f in (tmp_path / "h/membership").glob("*.json")]
    assert [json.loads(x)["id"] for x in lines if x] == ["a"]


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "series_id string, ts timestamp, value double").coalesce(1).write.parquet(f"{folder}/b{i}")


def test_late_records_heal_their_day(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2021, 1, d, h)
    feed(spark, tmp_path / "in", [[("s", t(1), 1.0), ("s", t(2), 5.0)], [("s", t(1, 5), 4.0), ("s", t(3), None)], [("s", t(20), 1.0)]])
    src = spark.read.parquet(str(tmp_path / "in/*"))
    e = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {str(r["date"]): r["value"] for r in ST.run_available(ST.healed_days(e), str(tmp_path / "run")).collect()}
    assert got == {"2021-01-01": 4.0, "2021-01-02": 5.0, "2021-01-03": None}


def test_periods_close_after_a_successor(spark, tmp_path):
    rows = [("s", dt.datetime(2021, 1, 1) + dt.timedelta(days=d), 1.0) for d in range(60)]
    feed(spark, tmp_path / "in", [rows])
    src = spark.read.parquet(str(tmp_path / "in/*"))
    e = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in/*"))
    out = ST.run_available(ST.closing_periods(e, "10 days", "5 days"), str(tmp_path / "run"))
    assert out.where("n = 10").count() == 5
    assert out.agg(F.max("period_start")).first()[0] < dt.date(2021, 2, 20)


def test_covered_months_upsert(spark, tmp_path):
    rows = [(i, dt.date(2022, 1, 1) + dt.timedelta(d), None if d >= 31 and i == "2" else 1.0) for i in ("1", "2") for d in range(59)]
    df = spark.createDataFrame(rows, "series_id string, date date, value double")
    put = ST.month_upsert(str(tmp_path / "out"))
    put(df, 0)
    put(df, 1)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 62 and {str(r[0]) for r in out.select("month").distinct().collect()} == {"2022-01-01"}


def month_rows(ids, first, days):
    return [(i, dt.date(2022, 1, 1) + dt.timedelta(d), float(d)) for i in ids for d in range(first, first + days)]


def test_month_in_two_batches_replay_and_late_series(spark, tmp_path):
    schema, out = "series_id string, date date, value double", str(tmp_path / "out")
    put = ST.month_upsert(out)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    put(frame(month_rows(("1", "2"), 0, 16)), 0)
    put(frame(month_rows(("1", "2"), 16, 15)), 1)
    put(frame(month_rows(("1", "2"), 16, 15)), 1)
    assert spark.read.parquet(out).count() == 62
    put(frame([("1", dt.date(2022, 1, 3), 99.0), ("2", dt.date(2022, 1, 3), None)]), 2)
    got = {r["series_id"]: r["value"] for r in spark.read.parquet(out).where("date = DATE'2022-01-03'").collect()}
    assert got == {"1": 99.0, "2": 2.0}
    # A new series takes coverage away until its own January arrives.
    put(frame(month_rows(("3",), 31, 5) + month_rows(("1", "2"), 31, 5)), 3)
    assert {str(r[0]) for r in spark.read.parquet(out).select("month").distinct().collect()} == {"2022-02-01"}
    put(frame(month_rows(("3",), 0, 31)), 4)
    assert spark.read.parquet(out).where("month = DATE'2022-01-01'").count() == 93


def test_snow_state_is_carried_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("s", dt.date(2021, 1, 1) + dt.timedelta(i), float(i % 4), float((i % 11) - 5)) for i in range(40)]
    schema = "series_id string, date date, p double, t double"
    for k, part in enumerate((rows[:15], rows[15:28], rows[28:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    try:
        got = ST.run_available(ST.snow_stream(e), str(tmp_path / "run")).orderBy("date").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = MR.snow_partition(spark.createDataFrame(rows, schema)).orderBy("date").collect()
    assert [r["snowpack_proxy"] for r in got] == pytest.approx([r["snowpack_proxy"] for r in want])
    assert [r["melt_input"] for r in got] == pytest.approx([r["melt_input"] for r in want])
