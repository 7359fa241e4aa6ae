"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one point of the index that remembers the smallest ids it stands for (as many as
an answer can hold), so copies neither swell the graph nor crowd an answer.  Points are dealt to
shards of bounded size by hash.  In each shard a random graph is improved in rounds: a greedy beam
search for every point proposes neighbours, pruning drops those that a kept neighbour is closer to (by the factor ``alpha``),
kept edges are offered in the other direction, and overfull points are pruned again.  A query runs a
beam search in every shard; distances are recomputed in double precision on the original vectors,
and the best of all shards are merged.

The index is a table in the shared folder.  Queries are dealt in blocks, so a task holds one shard
and one block whatever the table's size.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, as query or candidate; only vectors of the query's length are candidates; a repeated row
counts once; ties go to the smaller id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stash

ship(__name__)

SHARD, BLOCK = 4096, 4096
DEGREE, BEAM, ALPHA, ROUNDS = 32, 72, 1.2, 2
FLOATS = 1 << 22  # of the largest array of one step


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors moved and scaled to a range that single precision holds; the order of distances stays."""
    mid = x.mean(0)
    size = float(np.abs(x - mid).max()) or 1.0
    return ((x - mid) / size).astype(np.float32), mid, size


def beam_search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
    """For each query the ids and squared distances of its beam, best first, and the points it expanded (-1: none).

    All queries advance together: each step expands the best point of every beam that is still open.
    """
    b, n = len(q), len(x)
    norm = (x * x).sum(1)
    rows = np.arange(b)
    seen = np.zeros((b, n + 1), bool)
    seen[:, [start, n]] = True
    ids = np.full((b, beam), -1)
    far = np.full((b, beam), np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    ids[:, 0], open_[:, 0] = start, True
    far[:, 0] = norm[start] - 2 * q @ x[start]
    path = []
    while len(rows):
        at = np.where(open_[rows], far[rows], np.inf).argmin(1)
        live = open_[rows, at]
        rows, at = rows[live], at[live]
        if not len(rows):
            break
        open_[rows, at] = False
        now = np.full(b, -1)
        now[rows] = ids[rows, at]
        path.append(now)
        near = edges[now[rows]]
        new = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        reach = np.where(near < n, near, 0)
        d = np.where(new, norm[reach] - 2 * np.einsum("bd,brd->br", q[rows], x[reach]), np.inf).astype(np.float32)
        all_d = np.concatenate([far[rows], d], 1)
        keep = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        far[rows] = np.take_along_axis(all_d, keep, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], 1), keep, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new], 1), keep, 1) & np.isfinite(far[rows])
    order = far.argsort(1)
    far = np.take_along_axis(far, order, 1)
    return np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), -1), far + (q * q).sum(1)[:, None], path


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point among its candidates (n marks an empty place)."""
    n = len(x)
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    cand[cand == own[:, None]] = n
    safe = np.where(cand < n, cand, 0)
    v = x[safe]
    norm = (v * v).sum(2)
    p = x[own]
    d = np.where(cand < n, norm - 2 * np.einsum("bd,bcd->bc", p, v) + (p * p).sum(1)[:, None], np.inf)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(own), degree), n)
    rows = np.arange(len(own))
    for k in range(degree):
        best = d.argmin(1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        out[live, k] = cand[rows[live], best[live]]
        d[alpha * alpha * between[rows, best] <= d] = np.inf
        d[rows, best] = np.inf
    return out


def _pruned(x: np.ndarray, own: np.ndarray, lists: list[np.ndarray], degree: int, alpha: float) -> np.ndarray:
    """``prune`` for candidate lists of any length, in groups of similar length."""
    n, out = len(x), np.full((len(own), degree), len(x))
    order = np.argsort([len(c) for c in lists], kind="stable")
    i = 0
    while i < len(order):
        j, width = i, 1
        while j < len(order) and (w := max(width, len(lists[order[j]]))) * (w + x.shape[1]) * (j + 1 - i) <= max(FLOATS, w * (w + x.shape[1])):
            j, width = j + 1, w
        part = order[i:j]
        cand = np.full((len(part), width), n)
        for r, o in enumerate(part):
            cand[r, : len(lists[o])] = lists[o]
        out[part] = prune(x, own[part], cand, degree, alpha)
        i = j
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Edges (n, degree) of a shard, n where there is none, and the entry point."""
    x, _, _ = scaled(vectors)
    n = len(x)
    start = int((x * x).sum(1).argmin())
    if n <= degree + 1:
        edges = np.full((n, degree), n)
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, start
    edges = np.random.default_rng(5).integers(0, n, (n, degree))
    step = max(16, min(512, FLOATS // (degree * x.shape[1])))
    for k in range(rounds):
        factor = alpha if k == rounds - 1 else 1.0
        old, lists = edges, []
        for i in range(0, n, step):
            ids, _, _ = beam_search(x, old, x[i : i + step], start, beam)
            met = np.concatenate([ids, old[i : i + step]], 1)
            lists += [r[(r >= 0) & (r < n)] for r in met]
        edges = _pruned(x, np.arange(n), lists, degree, factor)
        # Offer every edge to its other end; points with too many are pruned again.
        a, c = np.nonzero(edges < n)
        ends = edges[a, c]
        order = np.argsort(ends, kind="stable")
        offers = np.split(a[order], np.searchsorted(ends[order], np.arange(1, n)))
        merged = [np.union1d(edges[i][edges[i] < n], offers[i]) for i in range(n)]
        full = np.array([i for i in range(n) if len(merged[i]) > degree], int)
        fit = np.full((n, degree), n)
        for i in range(n):
            if len(merged[i]) <= degree:
                fit[i, : len(merged[i])] = merged[i]
        if len(full):
            fit[full] = _pruned(x, full, [merged[i] for i in full], degree, factor)
        edges = fit
    return edges, start


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def points(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that take part, repeated rows once."""
    v = F.col("v")
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).distinct()


def index(pts: DataFrame, k: int = 10, shard_size: int = SHARD, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """``dims, shard, row, v, members, neighbours`` of every distinct vector; row 0 is the entry point of its shard."""
    ranked = pts.withColumn("_rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_rank") <= k + 1)
    distinct = stash(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "points")
    shards = max(1, math.ceil(distinct.count() / shard_size))
    dealt = distinct.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "members")
    schema = "dims int, shard int, row int, v array<double>, members array<bigint>, neighbours array<int>"

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"))
        edges, start = build(x, degree, beam)
        # The entry point becomes row 0.
        order = np.concatenate([[start], np.delete(np.arange(len(x)), start)])
        place = np.empty(len(x) + 1, int)
        place[order], place[len(x)] = np.arange(len(x)), -1
        near = [pa.scalar([int(j) for j in place[edges[i]] if j >= 0], pa.list_(pa.int32())) for i in order]
        t = t.take(pa.array(order))
        return pa.table({
            "dims": t.column("dims"), "shard": t.column("shard"), "row": pa.array(np.arange(len(x), dtype=np.int32)), "v": t.column("v"),
            "members": t.column("members"), "neighbours": pa.array([s.as_py() for s in near], pa.list_(pa.int32())),
        })

    return dealt.groupBy("dims", "shard").applyInArrow(run, schema)


def search(graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, block_size: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest points found for every query (``vec_id, v``), the query's own id left out."""
    # New columns: both sides of the cogroup stem from the same table.
    places = graph.select((F.col("dims") + 0).alias("dims"), (F.col("shard") + 0).alias("shard")).distinct()
    blocks = max(1, math.ceil(queries.count() / block_size))
    asked = queries.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    sent = asked.join(places, "dims").select((F.col("dims") + 0).alias("dims"), "shard", "block", "vec_id", "v")
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "query_id bigint, score double, members array<bigint>"
    types = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("members", pa.list_(pa.int64()))])

    def run(g: pa.Table, q: pa.Table) -> pa.Table:
        if not g.num_rows or not q.num_rows:
            return types.empty_table()
        g = g.sort_by("row")
        original, asks = _matrix(g.column("v")), _matrix(q.column("v"))
        x, mid, size = scaled(original)
        n = len(x)
        lists = g.column("neighbours").to_pylist()
        edges = np.full((n, max(1, max(map(len, lists)))), n)
        for i, near in enumerate(lists):
            edges[i, : len(near)] = near
        members, names = g.column("members").to_pylist(), q.column("vec_id").to_pylist()
        out: dict = {"query_id": [], "score": [], "members": []}
        step = max(16, min(512, FLOATS // (edges.shape[1] * x.shape[1])))
        for i in range(0, len(asks), step):
            part = asks[i : i + step]
            with np.errstate(all="ignore"):
                ids, _, _ = beam_search(x, edges, np.nan_to_num((part - mid) / size).astype(np.float32), 0, min(beam, max(n, 1)))
            for j, row in enumerate(ids):
                row = row[row >= 0]
                exact = np.sqrt(((original[row] - part[j]) ** 2).sum(1))
                for o in sorted(range(len(row)), key=lambda o: (exact[o], members[row[o]][0]))[: k + 1]:
                    out["query_id"].append(names[i + j])
                    out["score"].append(float(exact[o]))
                    out["members"].append(members[row[o]])
        return pa.table(out, types)

    keys = ("dims", "shard", "block")
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, schema)
    hits = found.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
