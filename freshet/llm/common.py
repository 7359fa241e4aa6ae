"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import scratch_folder

SLICE_BYTES = 4 << 20
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(name: str) -> None:
    """Let functions of this module travel to workers by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def per_worker(key: str, make: Callable[[], object], version: object = None) -> object:
    """An object that lives over the tasks of a Python worker, until another key or version takes its place.

    Only one is kept, so a worker that goes on to the next operator gives its memory back.
    """
    kept = sys.modules.setdefault("_freshet_worker", types.ModuleType("_freshet_worker")).__dict__
    if kept.get("what") != (key, version):
        kept["what"] = kept["held"] = None
        kept["held"] = make()
        kept["what"] = (key, version)
    return kept["held"]


def release() -> None:
    """Let go of what ``per_worker`` keeps."""
    per_worker("", lambda: None)


class Memo(dict):
    """``make(key)`` remembered in two generations of at most ``limit`` keys each; it only saves time."""

    def __init__(self, make: Callable, limit: int, keep: Callable[[object], bool] | None = None):
        super().__init__()
        self.make, self.limit, self.keep, self.old = make, limit, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.keep is not None and not self.keep(key):
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of executors; what was shuffled for it goes."""
    path = scratch_folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the columns that results are about to replace; names compare as Spark compares them."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def pieces(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes; a longer row stays whole."""
    if not batch.num_rows:
        return
    per_row = max(1, batch.nbytes // batch.num_rows)
    long = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    sizes = [sum(x) for x in zip(*[pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in long])] if long else [per_row] * batch.num_rows
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 16
    yield batch.slice(start)


def extend(df: DataFrame, fields: Sequence[tuple[str, str]], make: Callable[[], Callable[[pa.RecordBatch], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """Add columns that a function computes per Arrow batch; columns of the same names are replaced.

    ``make`` runs once per task and returns the function from a batch to a list of arrays.
    """
    names = [n for n, _ in fields]
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names}]

    def run(batches):
        fn = make()
        for batch in batches:
            for part in pieces(batch, limit):
                new = fn(part)
                at = [i for i, n in enumerate(part.schema.names) if n.lower() not in {x.lower() for x in names}]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in at], *new], names=[*[part.schema.names[i] for i in at], *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"`{n}` {t}" for n, t in fields]])
    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list:
    """The UTF-8 bytes of each text, None where it is null."""
    return column.cast(pa.binary()).to_pylist()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def crc_share(id_column: Column, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo ``parts``."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
