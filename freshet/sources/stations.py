"""Station files as a Spark data source, for batch reads and streams.

``stations.register(spark)`` makes the format ``station_files`` known.  Two layouts:

``headed``
    lines ``# key: value``, then a line of column names, then ``date;time;value`` rows;
``columns``
    one CSV per series: a line of column names, the series id in the file's name.

Options: ``path`` (local, or any address that pyarrow opens), ``layout``, ``pattern`` (of file names),
``value`` (column to read), ``date`` (its day column), ``ids`` and ``countries`` (comma lists), ``missing``
(the number that stands for no value), ``partitionBytes``, ``settle`` (streams, seconds).

Small files are packed into partitions of about ``partitionBytes``; each file is read line by line, so memory
does not grow with it.  Filters on ``series_id`` and ``country`` reach the reader: with the id in the file's
name other files are not opened, with the id in the header only their headers are read.

Writing takes rows of ``series_id``, ``line`` and perhaps ``country``, those of a series one after another in one
partition, and makes one headed file per series.  A task fills a hidden folder of its own; the end of the job shows
these folders, so the driver's part grows with tasks and not with files.  The address needs folders that
can be renamed (local, HDFS).

A stream's offset is the latest (time of change, path) it has handed out, so a batch is the files
between two offsets and a replay reads the same ones.  Files must not change once written, and
appear with the present time; those younger than ``settle`` wait for the next batch.

Defined cases: a file without the value column, without an id, or with coordinates that are no numbers
gives no rows; a row without a readable day or number is skipped, and so is a missing value; areas
of zero or less are null; an empty folder is an empty table; bytes outside ASCII are read as Latin-1.
"""

from __future__ import annotations

import fnmatch
import math
import sys
import time
import uuid
from collections.abc import Iterator
from datetime import date
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "series_id string, station string, river string, country string, lat double, lon double, area_km2 double, date date, value double, file string"
ARROW = pa.schema([
    *[(n, pa.string()) for n in ("series_id", "station", "river", "country")], *[(n, pa.float64()) for n in ("lat", "lon", "area_km2")],
    ("date", pa.date32()), ("value", pa.float64()), ("file", pa.string()),
])
# Words that open the header lines of the files.
HEADER = {"GRDC-No.": "series_id", "Station": "station", "River": "river", "Country": "country", "Latitude": "lat", "Longitude": "lon", "Catchment area": "area_km2"}
NO_DATA = -999.0
ROWS = 1 << 16  # rows of a batch
EPOCH = date(1970, 1, 1).toordinal()


class Settings:
    """Options of a read."""

    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        if not get("path"):
            raise ValueError("station_files needs a path")
        self.path, self.layout = get("path"), get("layout", "headed")
        if self.layout not in ("headed", "columns"):
            raise ValueError(f"unknown layout of station files: {self.layout}")
        headed = self.layout == "headed"
        self.pattern, self.separator = get("pattern", "*.txt" if headed else "*.csv"), ";" if headed else ","
        self.value, self.date = get("value", "Value" if headed else "value"), get("date", "YYYY-MM-DD" if headed else "date")
        self.missing = float(get("missing", str(NO_DATA)))
        self.partition_bytes, self.settle = int(get("partitionbytes", str(32 << 20))), float(get("settle", "10"))
        self.wanted = {c: set(get(o).split(",")) for c, o in (("series_id", "ids"), ("country", "countries")) if get(o)}

    def narrow(self, column: str, values: set[str]) -> None:
        self.wanted[column] = self.wanted.get(column, values) & values

    def keeps(self, meta: dict) -> bool:
        return all(meta.get(c) in values for c, values in self.wanted.items())

    def files(self) -> list[tuple[int, str, int]]:
        """Time of change, path and size of the files, oldest first."""
        fs, root = opened(self.path)
        found = fs.get_file_info(pfs.FileSelector(root, recursive=True, allow_not_found=True))
        # As for Spark's own readers, what lies in hidden folders (unfinished writes) is not there yet.
        shown = lambda f: not any(x.startswith((".", "_")) for x in f.path[len(root.rstrip("/")) :].split("/"))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and shown(f) and fnmatch.fnmatchcase(f.base_name, self.pattern))

    def named(self, path: str) -> str | None:
        """The series id as far as the file's name tells it."""
        return path.rsplit("/", 1)[-1].rsplit(".", 1)[0] if self.layout == "columns" else None

    def packed(self, files: list[tuple[int, str, int]]) -> list[Pack]:
        """Partitions of about equal bytes."""
        ids = self.wanted.get("series_id")
        out, held = [], 0
        for _, path, size in files:
            if ids is not None and self.layout == "columns" and self.named(path) not in ids:
                continue
            if not out or held + size > self.partition_bytes:
                out.append([])
                held = 0
            out[-1].append(path)
            held += size
        return [Pack(paths) for paths in out]


class Pack(InputPartition):
    """The files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    """File system and path of an address; ``file:/x`` is Hadoop's way to write a local one."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path)


def number(text: str) -> float | None:
    """A finite number, or None."""
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def lines(fs: pfs.FileSystem, path: str) -> Iterator[str]:
    """Lines of a file, read in blocks."""
    rest = b""
    with fs.open_input_stream(path) as f:
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x.decode("latin-1").strip() for x in whole)
    if rest:
        yield rest.decode("latin-1").strip()


def described(fields: dict[str, str]) -> dict | None:
    """Typed header of a station, None if it has no id or unreadable coordinates."""
    meta: dict = {c: fields.get(c) for c in ("series_id", "station", "river", "country")}
    for c in ("lat", "lon", "area_km2"):
        meta[c] = number(fields[c]) if c in fields else None
    if not meta["series_id"] or any(c in fields and meta[c] is None for c in ("lat", "lon")):
        return None
    if meta["area_km2"] is not None and meta["area_km2"] <= 0:
        meta["area_km2"] = None
    return meta


def read_file(set_: Settings, fs: pfs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
    """Rows of one file, a batch at a time."""
    rows = lines(fs, path)
    fields = {"series_id": set_.named(path)} if set_.layout == "columns" else {}
    at = None
    for line in rows:
        if line.startswith("#") and set_.layout == "headed":
            key, _, value = line[1:].partition(":")
            name = next((c for mark, c in HEADER.items() if key.strip().startswith(mark)), None)
            if name:
                fields[name] = value.strip()
            continue
        names = [c.strip() for c in line.split(set_.separator)]
        if set_.date in names:
            at = names.index(set_.date), names.index(set_.value) if set_.value in names else -1
            break
    meta = described(fields)
    if at is None or at[1] < 0 or meta is None or not set_.keeps(meta):
        return
    days: list[int] = []
    values: list[float] = []

    def batch() -> pa.RecordBatch:
        same = [pa.array([meta[f.name]], f.type).take(pa.array([0] * len(days), pa.int32())) for f in list(ARROW)[:7]]
        shown = pa.array([path], pa.string()).take(pa.array([0] * len(days), pa.int32()))
        return pa.RecordBatch.from_arrays([*same, pa.array(days, pa.int32()).cast(pa.date32()), pa.array(values, pa.float64()), shown], schema=ARROW)

    for line in rows:
        cells = line.split(set_.separator)
        if len(cells) <= max(at):
            continue
        value = number(cells[at[1]])
        if value is None or value == set_.missing:
            continue
        try:
            days.append(date.fromisoformat(cells[at[0]].strip()).toordinal() - EPOCH)
        except ValueError:
            continue
        values.append(value)
        if len(days) == ROWS:
            yield batch()
            days, values = [], []
    if days:
        yield batch()


def read_pack(set_: Settings, part: Pack | None) -> Iterator[pa.RecordBatch]:
    """Rows of the files of a partition; a read without files has one partition that is None."""
    fs, _ = opened(set_.path)
    for path in part.paths if part else []:
        yield from read_file(set_, fs, path)


class Reader(DataSourceReader):
    """Batch read with pruning by id and country."""

    def __init__(self, set_: Settings):
        self.set_ = set_

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("series_id", "country"):
                self.set_.narrow(f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value))
            else:
                yield f

    def partitions(self) -> list[Pack]:
        return self.set_.packed(self.set_.files())

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return read_pack(self.set_, partition)


class StreamReader(DataSourceStreamReader):
    """Files in the order in which they changed last."""

    def __init__(self, set_: Settings):
        self.set_ = set_
        self.seen: tuple[int, str] = (0, "")

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        limit = time.time_ns() - int(self.set_.settle * 1e9)
        ready = [(t, path) for t, path, _ in self.set_.files() if t <= limit]
        self.seen = max(self.seen, ready[-1] if ready else (0, ""))
        return {"time": self.seen[0], "path": self.seen[1]}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        lo, hi = ((o["time"], o["path"]) for o in (start, end))
        self.seen = max(self.seen, hi)
        return self.set_.packed([f for f in self.set_.files() if lo < f[:2] <= hi])

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return read_pack(self.set_, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


class Written(WriterCommitMessage):
    """The folder that a task has filled."""

    def __init__(self, folder: str):
        self.folder = folder


class Writer(DataSourceArrowWriter):
    """One headed file per series; a task holds the lines of one series, which the calendar bounds."""

    def __init__(self, set_: Settings, columns: list[str], overwrite: bool):
        if set_.layout != "headed" or not {"series_id", "line"} <= set(columns):
            raise ValueError("station files are written with the headed layout, from series_id and line")
        self.set_, self.overwrite, self.job = set_, overwrite, uuid.uuid4().hex

    def pending(self, root: str) -> str:
        return f"{root.rstrip('/')}/.pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.set_.path)
        folder = f"{self.pending(root)}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        held: list[str] = []
        series = country = None
        count = 0

        def put() -> None:
            marks = [f"# {mark}: {value}" for mark, value in (("GRDC-No.", series), ("Country", country)) if value is not None]
            body = "\n".join([*marks, f"{self.set_.date};hh:mm; {self.set_.value}", *held, ""])
            with fs.open_output_stream(f"{folder}/{quote(series or '', safe='')[:150]}-{count}.txt") as f:
                f.write(body.encode("latin-1", "replace"))

        for batch in iterator:
            ids, texts = batch.column("series_id").to_pylist(), batch.column("line").to_pylist()
            places = batch.column("country").to_pylist() if "country" in batch.schema.names else [None] * len(ids)
            for id_, text, place in zip(ids, texts, places):
                if id_ != series and held:
                    put()
                    held, country, count = [], None, count + 1
                series = id_
                country = max(country, place) if country is not None and place is not None else country if place is None else place
                held.append(text or "")
        if held:
            put()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.set_.path)
        if self.overwrite:
            for f in fs.get_file_info(pfs.FileSelector(root, allow_not_found=True)):
                if not f.base_name.startswith("."):
                    fs.delete_file(f.path) if f.is_file else fs.delete_dir(f.path)
        for n, m in enumerate(m for m in messages if m):
            fs.move(m.folder, f"{root.rstrip('/')}/part-{n:05d}-{self.job}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.set_.path)
        if fs.get_file_info(self.pending(root)).type != pfs.FileType.NotFound:
            fs.delete_dir(self.pending(root))


class StationFiles(DataSource):
    """``spark.read.format("station_files")``, and ``df.write`` with the same format."""

    @classmethod
    def name(cls) -> str:
        return "station_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(Settings(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Settings(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(Settings(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters passed on to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StationFiles)
