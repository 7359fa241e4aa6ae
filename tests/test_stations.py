"""The station file format: layouts, damaged files, pruning, packing and streams."""

import datetime as dt
import os

import pytest

from freshet.sources import stations as ST

HEAD = "# Title: daily\r\n# GRDC-No.: {id}\r\n# River: {river}\r\n# Station: S{id}\r\n# Country: {country}\r\n# Latitude (DD): {lat}\r\n# Longitude (DD): 40.5\r\n# Catchment area (km\xb2): {area}\r\n#\r\nYYYY-MM-DD;hh:mm; Value\r\n"


def put(folder, id, rows, country="RU", lat="60.25", area="12.5", river="\xd8st", head=HEAD):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{id}.txt"
    path.write_bytes((head.format(id=id, country=country, lat=lat, area=area, river=river) + "\r\n".join(rows)).encode("latin-1"))
    return path


@pytest.fixture
def reader(spark):
    ST.register(spark)
    return lambda path, **options: spark.read.format("station_files").options(path=str(path), **options).load()


def test_headed_files_and_damaged_ones(spark, reader, tmp_path):
    put(tmp_path / "a", "1", ["2020-01-01;--:--;  1.5", "2020-01-02;--:--;-999.000", "2020-01-03;--:--;x", "2020-13-03;--:--;2", "short", "", "2020-01-05;--:--;nan", "2020-01-04;--:--;4"])
    put(tmp_path / "b", "2", ["2020-01-01;--:--;7"], country="FI", area="-999.0")
    put(tmp_path, "bad-lat", ["2020-01-01;--:--;7"], lat="north")
    put(tmp_path, "no-id", ["2020-01-01;--:--;7"], head=HEAD.replace("# GRDC-No.: {id}\r\n", ""))
    put(tmp_path, "no-body", [], head="# GRDC-No.: 9\r\n")
    put(tmp_path, "other-column", ["2020-01-01;--:--;7"], head=HEAD.replace("Value", "Level"))
    (tmp_path / "empty.txt").write_bytes(b"")
    put(tmp_path / "_temporary" / "0", "half", ["2020-01-01;--:--;7"])
    (tmp_path / "1.md").write_text("2020-01-01;--:--;1")
    got = sorted((r.series_id, r.country, r.river, r.area_km2, str(r.date), r.value) for r in reader(tmp_path).collect())
    assert got == [("1", "RU", "\xd8st", 12.5, "2020-01-01", 1.5), ("1", "RU", "\xd8st", 12.5, "2020-01-04", 4.0), ("2", "FI", "\xd8st", None, "2020-01-01", 7.0)]
    assert reader(tmp_path, value="Level").first().series_id == "other-column"
    assert reader(tmp_path / "absent").count() == 0
    with pytest.raises(Exception, match="layout"):
        reader(tmp_path, layout="odd").count()


def test_columns_layout(reader, tmp_path):
    (tmp_path / "007.csv").write_text("date,q_cms,x\n2020-01-01,1.5,9\n2020-01-02,,9\n2020-01-03,nan,9\n")
    (tmp_path / "8.csv").write_text("x,date,q_cms\n1,2020-01-01,2\n")
    (tmp_path / "9.csv").write_text("date,other\n2020-01-01,2\n")
    df = reader(tmp_path, layout="columns", value="q_cms")
    assert sorted((r.series_id, str(r.date), r.value) for r in df.collect()) == [("007", "2020-01-01", 1.5), ("8", "2020-01-01", 2.0)]
    assert [r.series_id for r in df.where("series_id = '8'").collect()] == ["8"]


def test_filters_reach_the_reader(reader, tmp_path, spark):
    for i in range(6):
        put(tmp_path, str(i), [f"2020-01-0{d};--:--;{d}" for d in range(1, 6)], country="RU" if i % 2 else "FI")
    df = reader(tmp_path)
    few = df.where("series_id IN ('1', '2', '3') AND country = 'RU' AND value > 2")
    assert sorted((r.series_id, r.value) for r in few.collect()) == [(i, v) for i in ("1", "3") for v in (3.0, 4.0, 5.0)]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "series_id IN" not in plan and "value" in plan
    assert reader(tmp_path, countries="FI").where("country = 'RU'").count() == 0
    set_ = ST.Settings({"path": str(tmp_path), "partitionBytes": "1"})
    assert len(set_.packed(set_.files())) == 6 and len(ST.Settings({"path": str(tmp_path)}).packed(set_.files())) == 1
    assert ST.Settings({"path": f"file:{tmp_path}"}).files() == ST.Settings({"path": f"file://{tmp_path}"}).files() == set_.files()


def test_long_file_in_several_batches(reader, tmp_path, monkeypatch):
    days = [(dt.date(1900, 1, 1) + dt.timedelta(i)).isoformat() for i in range(1000)]
    put(tmp_path, "1", [f"{d};--:--;{i}" for i, d in enumerate(days)])
    monkeypatch.setattr(ST, "ROWS", 128)
    assert sorted((str(r.date), r.value) for r in reader(tmp_path).collect()) == [(d, float(i)) for i, d in enumerate(days)]


def test_stream_restarts_where_it_stopped(spark, reader, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "run"

    def drain():
        s = spark.readStream.format("station_files").options(path=str(inbox), settle="0").load().select("series_id", "date", "value")
        q = s.writeStream.format("parquet").option("path", str(out / "data")).option("checkpointLocation", str(out / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.series_id, r.value) for r in spark.read.parquet(str(out / "data")).collect())

    put(inbox, "1", ["2020-01-01;--:--;1"])
    put(inbox, "2", ["2020-01-01;--:--;2"])
    assert drain() == [("1", 1.0), ("2", 2.0)]
    assert drain() == [("1", 1.0), ("2", 2.0)]
    put(inbox, "0", ["2020-01-01;--:--;3"])
    assert drain() == [("0", 3.0), ("1", 1.0), ("2", 2.0)]


def test_offsets(tmp_path):
    for name, at in (("a", 100), ("c", 200), ("b", 200)):
        os.utime(put(tmp_path, name, ["2020-01-01;--:--;1"]), ns=(at, at))
    s = ST.StreamReader(ST.Settings({"path": str(tmp_path)}))
    end = s.latestOffset()
    assert end == {"time": 200, "path": str(tmp_path / "c.txt")}
    names = lambda parts: [p.rsplit("/", 1)[-1] for x in parts for p in x.paths]
    assert names(s.partitions(s.initialOffset(), end)) == ["a.txt", "b.txt", "c.txt"]
    assert names(s.partitions({"time": 200, "path": str(tmp_path / "b.txt")}, end)) == ["c.txt"] and s.partitions(end, end) == []
    put(tmp_path, "young", ["2020-01-01;--:--;1"])
    assert s.latestOffset() == end
