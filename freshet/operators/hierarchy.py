"""Hierarchical clustering of any number of vectors over a bounded number of leaves.

A leaf is a clustering feature: number of vectors, their mean, and their squared deviation.  Each task gathers its
vectors into at most ``limit`` leaves, splitting the loosest group along its widest axis until the limit is reached;
leaves of tasks are merged in groups of ``FAN`` and condensed again, level by level, so no task and no driver ever
holds more than a few times ``limit`` leaves.  Up to ``limit`` distinct vectors, every vector is its own leaf and the results
are those of the plain methods.

Over the leaves run Ward linkage (nearest-neighbour chains), and density clusters with noise: the spanning tree
of mutual reachability, condensed to splits whose two sides are large enough, of which the most stable are kept.
Vectors then take the label of their nearest leaf, block by block.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import ID, adjusted_rand, relabel_by_size

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAVES = 4096
FAN = 8
ROWS = 512  # vectors that are assigned at once: 16 MB of distances to all leaves


@dataclass
class Leaves:
    """``n`` vectors with mean ``centre`` and summed squared deviation ``spread``, one entry per leaf."""

    n: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    @staticmethod
    def of(x: np.ndarray) -> Leaves:
        return Leaves(np.ones(len(x)), x, np.zeros(len(x)))

    def joined(self, other: Leaves) -> Leaves:
        return Leaves(np.concatenate([self.n, other.n]), np.concatenate([self.centre, other.centre]), np.concatenate([self.spread, other.spread]))

    def merged(self, label: np.ndarray) -> Leaves:
        """One leaf per label 0, 1, ..."""
        k = int(label.max(initial=-1)) + 1
        n = np.bincount(label, self.n, k)
        sums = np.zeros((k, self.centre.shape[1]))
        np.add.at(sums, label, self.centre * self.n[:, None])
        centre = sums / n[:, None]
        away = ((self.centre - centre[label]) ** 2).sum(axis=1)
        return Leaves(n, centre, np.bincount(label, self.spread + self.n * away, k))

    def condensed(self, limit: int) -> Leaves:
        """At most ``limit`` leaves; equal centres become one first."""
        if len(self) <= limit:
            return self
        own = self.merged(np.unique(self.centre, axis=0, return_inverse=True)[1].reshape(-1))
        if len(own) <= limit:
            return own

        def loose(at: np.ndarray) -> tuple[float, int, float]:
            w, c = own.n[at], own.centre[at]
            mean = (w[:, None] * c).sum(axis=0) / w.sum()
            var = (w[:, None] * (c - mean) ** 2).sum(axis=0)
            axis = int(var.argmax())
            return float(var.sum()), axis, float(mean[axis])

        everything = np.arange(len(own))
        queue, number, done = [(-loose(everything)[0], 0, everything)], 1, []
        while queue and len(queue) + len(done) < limit:
            _, _, at = heapq.heappop(queue)
            if len(at) == 1:
                done.append(at)
                continue
            _, axis, mean = loose(at)
            left = own.centre[at, axis] <= mean
            if left.all():  # the mean rounds to the largest value
                left = own.centre[at, axis] < own.centre[at, axis].max()
            for part in (at[left], at[~left]):
                heapq.heappush(queue, (-loose(part)[0], number, part))
                number += 1
        label = np.empty(len(own), np.int64)
        for i, at in enumerate([*done, *[q[2] for q in queue]]):
            label[at] = i
        return own.merged(label)


def _read(batch) -> Leaves:
    dim = len(batch["centre"][0].as_py()) // 8
    centre = np.frombuffer(b"".join(batch["centre"].to_pylist()), float).reshape(-1, dim)
    return Leaves(batch["n"].to_numpy(), centre, batch["spread"].to_numpy())


def _write(leaves: Leaves) -> list[pa.Array]:
    return [pa.array(leaves.n), pa.array([c.tobytes() for c in leaves.centre], pa.binary()), pa.array(leaves.spread)]


FIELDS = "n double, centre binary, spread double"


def summarise(vectors: DataFrame, limit: int = LEAVES) -> Leaves | None:
    """Leaves of all vectors, None for an empty table."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches):
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit).column(0)
                x = part.flatten().to_numpy().reshape(len(part), -1)
                held = Leaves.of(x) if held is None else held.joined(Leaves.of(x))
                if len(held) > 4 * limit:
                    held = held.condensed(limit)
        if held is not None:
            held = held.condensed(limit)
            yield pa.RecordBatch.from_arrays(_write(held), names=["n", "centre", "spread"])

    def merge(table: pa.Table) -> pa.Table:
        leaves = _read(table).condensed(limit)
        return pa.table([pa.array([table["part"][0].as_py() // FAN] * len(leaves)), *_write(leaves)], names=["part", "n", "centre", "spread"])

    x = vectors.select(vector_to_array("features").alias("x")).mapInArrow(gather, FIELDS)
    level = x.select(F.floor(F.pmod(F.spark_partition_id(), F.lit(parts)) / FAN).cast("bigint").alias("part"), "n", "centre", "spread")
    while True:
        level = level.groupBy("part").applyInArrow(merge, f"part bigint, {FIELDS}")
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    table = level.select("n", "centre", "spread").toArrow()  # at most ``limit`` rows
    if not table.num_rows:
        return None
    leaves = _read(table)
    order = np.lexsort(leaves.centre.T[::-1])
    return Leaves(leaves.n[order], leaves.centre[order], leaves.spread[order])


def nearest(x: np.ndarray, centres: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Row of the nearest centre of each vector, given the centres' squared lengths."""
    d = x @ centres.T
    d *= -2
    d += norms
    return d.argmin(axis=1)


def assign(vectors: DataFrame, leaves: Leaves, values: dict[str, tuple[str, np.ndarray]], id_col: str = ID) -> DataFrame:
    """Every vector with the values (type and array) of its nearest leaf, the first among equals."""
    norms = (leaves.centre**2).sum(axis=1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                own = nearest(x, leaves.centre, norms)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v[own]) for _, v in values.values()]], names=[id_col, *values])

    ids = vectors.select(id_col).schema.fields[0].dataType.simpleString()
    return vectors.select(id_col, vector_to_array("features")).mapInArrow(run, f"{id_col} {ids}, " + ", ".join(f"{c} {t}" for c, (t, _) in values.items()))


# --- Ward linkage --------------------------------------------------------------------------------------------


def ward_merges(leaves: Leaves) -> list[tuple[float, int, int]]:
    """All merges as ``(height, a, b)`` by rising height; a cluster is named by one of its leaves."""
    n, c = leaves.n.astype(float).copy(), leaves.centre.astype(float).copy()
    alive = np.ones(len(n), bool)
    out, chain = [], []
    for _ in range(len(n) - 1):
        while True:
            if not chain:
                chain.append(int(np.argmax(alive)))
            a = chain[-1]
            d = n * n[a] / (n + n[a]) * ((c - c[a]) ** 2).sum(axis=1)
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]  # nearest to each other
                break
            chain.append(b)
        chain = chain[:-2]
        out.append((float(np.sqrt(2 * d[b])), a, b))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
    return sorted(out, key=lambda m: m[0])


def ward_labels(leaves: Leaves, k: int) -> np.ndarray:
    """Cluster 0..k-1 of every leaf: the tree cut where k clusters are left."""
    up = np.arange(len(leaves))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, a, b in ward_merges(leaves)[: max(0, len(leaves) - k)]:
        up[find(b)] = find(a)
    return np.unique([find(i) for i in range(len(up))], return_inverse=True)[1].astype(np.int32)


def ward_regimes(vectors: DataFrame, k: int = 15, limit: int = LEAVES, id_col: str = ID) -> DataFrame:
    """``id, cluster, regime``: Ward clusters, numbered from 1 by falling size."""
    leaves = summarise(vectors, limit)
    if leaves is None:
        return vectors.select(id_col, F.lit(0).alias("cluster"), F.lit(1).alias("regime"))
    return relabel_by_size(assign(vectors, leaves, {"cluster": ("int", ward_labels(leaves, k))}, id_col)).select(id_col, "cluster", "regime")


# --- density clusters ----------------------------------------------------------------------------------------


def core_distances(leaves: Leaves, samples: int) -> np.ndarray:
    """Distance within which a leaf has ``samples`` vectors around it, its own included (or all there are)."""
    c, n = leaves.centre, leaves.n
    norms, out = (c**2).sum(axis=1), np.zeros(len(n))
    for at in range(0, len(n), 512):
        part = slice(at, at + 512)
        rough = norms[part, None] + norms - 2 * c[part] @ c.T
        order = np.argsort(rough, axis=1, kind="stable")
        enough = (np.cumsum(n[order], axis=1) < samples).sum(axis=1).clip(max=len(n) - 1)
        pick = order[np.arange(len(enough)), enough]
        out[part] = np.sqrt(((c[part] - c[pick]) ** 2).sum(axis=1))
    return out


def spanning_tree(leaves: Leaves, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of the smallest tree over mutual reachability, by rising length."""
    c, size = leaves.centre, len(leaves)
    best, link = np.full(size, np.inf), np.zeros(size, np.int64)
    open_, at, out = np.ones(size, bool), 0, []
    for _ in range(size - 1):
        open_[at] = False
        reach = np.maximum(np.sqrt(((c - c[at]) ** 2).sum(axis=1)), np.maximum(core, core[at]))
        closer = open_ & (reach < best)
        best[closer], link[closer] = reach[closer], at
        at = int(np.where(open_, best, np.inf).argmin())
        out.append((float(best[at]), int(link[at]), at))
    return sorted(out)


def density_labels(leaves: Leaves, min_size: float, samples: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of every leaf (-1: noise; 0, 1, ... by falling size) and its membership from 0 to 1."""
    size = len(leaves)
    label, member = np.full(size, -1, np.int32), np.zeros(size)
    if size < 2:
        return label, member
    edges = spanning_tree(leaves, core_distances(leaves, samples or int(min_size)))
    tiny = 1e-12 * max(edges[-1][0], 1e-300)  # copies part at a finite density
    # The dendrogram: node i below ``size`` is a leaf; edges of equal length join all that they join at once.
    up, node_of, weight, kids, density = list(range(size)), list(range(size)), leaves.n.tolist(), {}, {}

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    at = 0
    while at < len(edges):
        stop = at
        while stop < len(edges) and edges[stop][0] == edges[at][0]:
            stop += 1
        olds = {find(v) for edge in edges[at:stop] for v in edge[1:]}
        for _, a, b in edges[at:stop]:
            up[find(a)] = find(b)
        groups: dict[int, list[int]] = {}
        for old in sorted(olds):
            groups.setdefault(find(old), []).append(node_of[old])
        for new, parts in groups.items():
            node_of[new] = len(weight)
            kids[len(weight)], density[len(weight)] = parts, 1 / max(edges[at][0], tiny)
            weight.append(sum(weight[k] for k in parts))
        at = stop

    def below(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < size:
                out.append(x)
            else:
                todo += kids[x]
        return out

    # Condensed: a cluster goes on until both sides of a split are large enough; what splits off before leaves it.
    root = len(weight) - 1
    birth, stable, parent, own, top = {root: 0.0}, {root: 0.0}, {}, {}, {}
    falls = np.zeros(size)
    todo = [(root, root)]  # cluster, node
    while todo:
        cluster, node = todo.pop()
        if node < size:
            own[node], falls[node] = cluster, birth[cluster]
            continue
        at, large = density[node], [k for k in kids[node] if weight[k] >= min_size]
        stable[cluster] += (at - birth[cluster]) * sum(weight[k] for k in kids[node] if len(large) > 1 or k not in large)
        top[cluster] = max(top.get(cluster, 0.0), at)
        for k in kids[node]:
            if len(large) > 1 and k in large:
                birth[k], stable[k], parent[k] = at, 0.0, cluster
                todo.append((k, k))
            elif k in large:
                todo.append((cluster, k))
            else:
                for leaf in below(k):
                    own[leaf], falls[leaf] = cluster, at
    chosen, gain = set(), {}
    inner: dict[int, list[int]] = {}
    for c, p in parent.items():
        inner.setdefault(p, []).append(c)
    for c in sorted(parent):  # a node comes after those below it
        best = sum(gain[k] for k in inner.get(c, []))
        gain[c] = max(best, stable[c])
        if stable[c] >= best:
            todo = list(inner.get(c, []))
            while todo:
                x = todo.pop()
                chosen.discard(x)
                todo += inner.get(x, [])
            chosen.add(c)
    home: dict[int, int] = {}
    for c in sorted(birth, reverse=True):
        home[c] = c if c in chosen else home.get(parent.get(c, -1), -1)
    found = np.array([home[own[i]] for i in range(size)])
    mass = {c: float(leaves.n[found == c].sum()) for c in chosen}
    for new, c in enumerate(sorted(chosen, key=lambda c: (-mass[c], int(np.argmax(found == c))))):
        inside = found == c
        label[inside] = new
        member[inside] = np.minimum(falls[inside] / top[c], 1.0) if top.get(c) else 1.0
    return label, member


def density_members(vectors: DataFrame, min_size: int = 40, limit: int = LEAVES, id_col: str = ID) -> DataFrame:
    """``id, end_member, membership``: density clusters of at least ``min_size`` vectors, -1 for noise."""
    leaves = summarise(vectors, limit)
    if leaves is None:
        return vectors.select(id_col, F.lit(-1).alias("end_member"), F.lit(0.0).alias("membership"))
    label, member = density_labels(leaves, min_size)
    return assign(vectors, leaves, {"end_member": ("int", label), "membership": ("double", member)}, id_col)


def density_stability(
    vectors: DataFrame, labels: DataFrame, share: float = 0.85, rounds: int = 20, seed: int = 42, id_col: str = ID, min_size: int = 40, limit: int = LEAVES
) -> DataFrame:
    """Adjusted Rand index between the labels and those of hashed subsamples, over vectors that both cluster."""
    rows = []
    for i in range(rounds):
        pick = F.pmod(F.xxhash64(id_col, F.lit(seed + i)), F.lit(10_000)) < int(share * 10_000)
        sub = density_members(vectors.where(pick), min_size, limit, id_col).select(id_col, F.col("end_member").alias("b"))
        both = labels.select(id_col, F.col("end_member").alias("a")).join(sub, id_col).where("a >= 0 AND b >= 0")
        r = adjusted_rand(both, "a", "b").first()
        rows.append((i, r["ari"], r["n"]))
    return vectors.sparkSession.createDataFrame(rows, "round int, ari double, n long")


def density_sweep(vectors: DataFrame, regimes: DataFrame, sizes: Sequence[int], limit: int = LEAVES, id_col: str = ID) -> DataFrame:
    """Number of density clusters and Rand index against regimes for several minimum sizes; leaves are made once."""
    leaves, rows = summarise(vectors, limit), []
    for s in sizes:
        if leaves is None:
            break
        e = assign(vectors, leaves, {"end_member": ("int", density_labels(leaves, s)[0])}, id_col)
        both = e.where("end_member >= 0").join(regimes.select(id_col, "regime"), id_col)
        r = adjusted_rand(both, "regime", "end_member").first()
        rows.append((s, int(density_labels(leaves, s)[0].max()) + 1, r["ari"], r["n"]))
    return vectors.sparkSession.createDataFrame(rows, "min_size int, n_end_members int, ari double, n_both long")
