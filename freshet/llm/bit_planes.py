"""Centroid clustering in exact integers: dot products by popcounts of bit planes.

Components become integers; bit j of all 64 components of a vector is one unsigned 64-bit number, its
plane j, in two's complement.  The dot product of a vector and a centroid is the sum over their planes of
the population count of ``v_i & c_j`` with weight 2^(i+j), negative where one of them is a sign plane; the squared
distance follows from it, so assignment and update have no rounding at all.

Vectors are packed once; each round is one pass over the planes with the centroids, 40 x 64 numbers, in the
closure, and brings back one sum per cluster and component, combined inside tasks first.  No vector
moves between tasks.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no
part; repeated rows count as vectors of their own; rows without an id are never starting centroids as long as there are others; fewer
vectors than clusters give as many clusters as vectors; an empty table gives no rows.  A component so large that
its distances may not fit a long is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stash

ship(__name__)

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
LARGEST = 1 << 27  # 64 * (2 * LARGEST) ** 2 is below 2 ** 63
ROWS = 8192  # vectors handled at once


def finite_vector(vector: Column, dim: int = DIM) -> Column:
    """True for vectors of ``dim`` finite components."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


def pack(ints: np.ndarray, width: int) -> np.ndarray:
    """``(n, width)`` planes of ``(n, 64)`` signed integers."""
    bits = (ints[:, None, :] >> np.arange(width)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").reshape(len(ints), -1).view("<u8").astype(np.uint64)


def unpack(planes: np.ndarray) -> np.ndarray:
    width = planes.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), width, 8), axis=2, bitorder="little")
    out = np.zeros((len(planes), DIM), np.int64)
    for j in range(width):
        out += bits[:, j].astype(np.int64) * weight(j, width)
    return out


def weight(j: int, width: int) -> int:
    return -(1 << j) if j == width - 1 else 1 << j


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact dot products of packed vectors with one packed vector (or row by row with as many)."""
    width, other_width = planes.shape[1], other.shape[-1]
    out = np.zeros(len(planes), np.int64)
    for i in range(width):
        for j in range(other_width):
            common = planes[:, i] & other[..., j]
            out += np.bitwise_count(common).astype(np.int64) * (weight(i, width) * weight(j, other_width))
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller among equals, and its squared distance."""
    best = np.full(len(planes), np.iinfo(np.int64).max)
    own = np.zeros(len(planes), np.int32)
    for c, packed in enumerate(pack(np.array(centroids, np.int64), width)):
        d = norms + sum(x * x for x in centroids[c]) - 2 * dots(planes, packed)
        closer = d < best
        best[closer], own[closer] = d[closer], c
    return own, best


def points(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, planes, norm`` of the vectors that take part, and the number of planes."""
    good = df.where(finite_vector(F.col(embedding))).select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    low, high = good.select(F.array_min("v").alias("lo"), F.array_max("v").alias("hi")).agg(F.min("lo"), F.max("hi")).first()
    reach = max(-(low or 0.0), high or 0.0) * scale
    if reach >= LARGEST:
        raise ArithmeticError(f"components of {reach} after scaling: squared distances may not fit 64 bits")
    width = int(reach + 1).bit_length() + 1
    ints = good.select("vec_id", scaled(F.col("v"), scale).alias("ints"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                planes = pack(part.column(1).flatten().to_numpy().reshape(-1, DIM), width)
                packed = pa.array([p.tobytes() for p in planes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.array(dots(planes, planes))], names=["vec_id", "planes", "norm"])

    kind = ints.schema["vec_id"].dataType.simpleString()
    return stash(ints.mapInArrow(run, f"vec_id {kind}, planes binary, norm bigint"), "planes"), width


def _planes(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(b"".join(batch.column("planes").to_pylist()), "<u8").reshape(-1, width)
    return np.asfortranarray(whole), batch.column("norm").to_numpy()


def seeds(pts: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[bytes]:
    """Planes of the vectors with the smallest hashes of ``seed:id``, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [bytes(r["planes"]) for r in pts.orderBy(mark.asc_nulls_last(), "planes").select("planes").limit(k).collect()]


def updated(pts: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The floor of the mean of every centroid's vectors; a centroid without any stays."""

    def run(batches):
        sums, sizes = np.zeros((len(centroids), DIM), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                planes, norms = _planes(batch.slice(at, ROWS), width)
                own = nearest(planes, norms, centroids, width)[0]
                order = np.argsort(own, kind="stable")
                held, starts = np.unique(own[order], return_index=True)
                sums[held] += np.add.reduceat(unpack(planes)[order], starts, axis=0)
                sizes += np.bincount(own, minlength=len(centroids))
        some = np.nonzero(sizes)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([[int(sizes[c]), *sums[c].tolist()] for c in some], pa.list_(pa.int64()))], names=["c", "s"])

    parts = pts.select("planes", "norm").mapInArrow(run, "c int, s array<bigint>").select("c", F.posexplode("s").alias("i", "s"))
    totals = parts.groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x 65 rows
    new: dict[int, list[int]] = {}
    for c, i, s in totals:
        new.setdefault(c, [0] * (DIM + 1))[i] = int(s)
    return [[x // new[c][0] for x in new[c][1:]] if c in new else old for c, old in enumerate(centroids)]


def cluster(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the centroids."""
    pts, width = points(df, vec_id, embedding, scale)
    first = seeds(pts, k, seed)
    centroids = unpack(np.frombuffer(b"".join(first), "<u8").reshape(-1, width)).tolist()
    for _ in range(rounds if centroids else 0):
        centroids = updated(pts, centroids, width)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own, d = nearest(*_planes(part, width), centroids, width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own), pa.array(d)], names=["vec_id", "cluster", "distance"])

    kind = pts.schema["vec_id"].dataType.simpleString()
    return pts.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), centroids


def described(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Every assignment with its cluster's and the whole inertia and a digest of its centroid."""
    assigned = stash(assigned, "assigned")
    spark = assigned.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    marks = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint").alias("cluster_inertia"))
    whole = assigned.agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint").alias("inertia"))
    # One row per cluster, and one row.
    return assigned.join(F.broadcast(sums.join(marks, "cluster")), "cluster").join(F.broadcast(whole)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
