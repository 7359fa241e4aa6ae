"""Embedding near-duplicates by tiled comparison in principal-component order.

All vectors of a label whose cosine reaches the threshold are linked, with none lost:

1. Exact copies become one row with a count, so a vector that fills a label costs one.
2. Unit vectors are rotated onto the principal axes of all vectors.  Two linked vectors differ by at most
   ``sqrt(2 - 2 threshold)`` along every axis, so cells of that width on the (at most three) axes that vary
   that much only meet their neighbours; inside cells a space-filling order over leading axes makes tiles compact.
3. A tile holds some 2,000 vectors.  Tiles of neighbouring cells are compared unless the boxes around them are too far
   apart.  Inside a pair of tiles, products of the leading dimensions are accumulated first; the rest of a product is
   at most the product of the suffix norms, and pairs, rows and columns that cannot reach the threshold are
   dropped between the steps.
4. What is within rounding of the threshold is decided on the original vectors in double precision.

A pair of tiles gives back a count per vector and the links that join components, never its pairs.  A tile's
partners are dealt in bounded groups over all tasks.  Components are found by ``components.components``.

Defined cases: rows whose label or vector is null, empty, zero or holds a null or non-finite component
link with nothing; vectors of different lengths do not link; repeated rows are copies of each other; a row without
an id takes the id of its component, null if that has none; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from .common import parts, ship, stash
from .components import components

ship(__name__)

THRESHOLD = 0.93
EPS = 1e-9  # far above the rounding of a rotated product
TILE, TILE_VALUES = 2048, 1 << 17  # vectors, and components, of a tile at most
PARTNERS = 8  # tiles that one group compares a tile with
AXES, LEAD = 3, 16  # axes of cells; axes of the boxes around tiles
MODELS = 8  # vector lengths with principal axes of their own; rarer lengths keep theirs
SHIFT, ROW_BITS = 21, 12  # bits of a cell's place on one axis, and of a tile's rows


def usable(vector: Column) -> Column:
    """True for vectors of finite components that are not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def steps(dim: int) -> list[int]:
    """Ends of the blocks of dimensions in which a product is accumulated."""
    out, at = [], 8
    while at < dim:
        out.append(at)
        at *= 2
    return [*out, dim]


def suffix_norms(x: np.ndarray, ends: list[int]) -> np.ndarray:
    """``(n, blocks)``: what is left of each vector's length behind each block."""
    return np.stack([np.sqrt((x[:, e:] ** 2).sum(axis=1)) for e in ends], axis=1)


class Side:
    """The vectors of one tile, as they are and on the principal axes."""

    def __init__(self, original: np.ndarray, axes: np.ndarray | None):
        self.original = original.astype(np.float64)
        u = units(self.original)
        self.turned = u if axes is None else u @ axes
        self.ends = steps(u.shape[1])
        self.tails = suffix_norms(self.turned, self.ends)


def linked_pairs(a: Side, b: Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs whose cosine reaches the threshold."""
    rows, cols = np.arange(len(a.turned)), np.arange(len(b.turned))
    acc, at = None, 0
    i = j = value = None  # set once few pairs are left
    for block, end in enumerate(a.ends):
        if i is None:
            new = a.turned[rows, at:end] @ b.turned[cols, at:end].T
            acc = new if acc is None else acc + new
            bound = acc + a.tails[rows, block][:, None] * b.tails[cols, block][None, :]
            alive = bound >= threshold - EPS
            left = np.count_nonzero(alive)
            if not left:
                return rows[:0], cols[:0]
            if left * 8 < alive.size:
                x, y = np.nonzero(alive)
                i, j, value, acc = rows[x], cols[y], acc[x, y], None
            else:
                r, c = alive.any(axis=1), alive.any(axis=0)
                if not (r.all() and c.all()):
                    rows, cols, acc = rows[r], cols[c], acc[np.ix_(r, c)]
        else:
            value = value + np.einsum("ij,ij->i", a.turned[i, at:end], b.turned[j, at:end])
            alive = value + a.tails[i, block] * b.tails[j, block] >= threshold - EPS
            i, j, value = i[alive], j[alive], value[alive]
        at = end
    if i is None:
        x, y = np.nonzero(acc >= threshold - EPS)
        i, j, value = rows[x], cols[y], acc[x, y]
    good = value >= threshold - EPS
    close = np.nonzero(good & (value < threshold + EPS))[0]
    good[close] = cosines(a.original[i[close]], b.original[j[close]]) >= threshold
    return i[good], j[good]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Smallest member of each of n nodes' component, and links that suffice for it."""
    up, kept = np.arange(n), []
    if len(i):
        x, y = np.divmod(np.unique(np.minimum(i, j) * n + np.maximum(i, j)), n)

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for p, q in zip(x.tolist(), y.tolist()):
            r, s = find(p), find(q)
            if r != s:
                up[max(r, s)] = min(r, s)
                kept.append((p, q))
        up = np.array([find(x) for x in range(n)])
    return up, kept


def principal_axes(distinct: DataFrame) -> dict[int, tuple[np.ndarray, list[int], list[float]]]:
    """Per vector length: axes by falling second moment, the axes worth cells, and the deviation along every axis.

    Moments are added up inside tasks; length squared numbers of at most ``MODELS`` lengths reach the driver.
    """
    sizes = distinct.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).where("n >= 4 * dim")
    dims = [r["dim"] for r in sizes.orderBy(F.desc("n"), "dim").limit(MODELS).collect()]
    if not dims:
        return {}

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in by_length(batch.column(0)):
                u = np.concatenate([units(x[1]), np.ones((len(x[1]), 1))], axis=1)
                held[dim] = held.get(dim, 0) + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.reshape(-1) for m in held.values()], pa.list_(pa.float64()))], names=["dim", "m"])

    moments = distinct.where(F.size("vec").isin(dims)).select("vec").mapInArrow(run, "dim int, m array<double>")
    cells = moments.select("dim", F.posexplode("m").alias("i", "m")).groupBy("dim", "i").agg(F.sum("m").alias("m")).orderBy("dim", "i").toArrow()
    out = {}
    for dim in dims:
        m = cells.filter(pc.equal(cells["dim"], dim))["m"].to_numpy().reshape(dim + 1, dim + 1)
        n = m[-1, -1]
        length, axes = np.linalg.eigh(m[:-1, :-1] / n)
        length, axes = length[::-1], np.ascontiguousarray(axes[:, ::-1])
        spread = np.sqrt(np.maximum(length - (m[-1, :-1] / n @ axes) ** 2, 0))
        out[dim] = axes, np.argsort(-spread, kind="stable")[:AXES].tolist(), spread.tolist()
    return out


def by_length(column: pa.Array):
    """``(dim, (positions, matrix))`` of an array column's vectors."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.nonzero(size == dim)[0]
        yield dim, (at, flat[(ends[at] - dim)[:, None] + np.arange(dim)].astype(np.float64))


def morton(x: np.ndarray) -> np.ndarray:
    """Bits of four coordinates in [-1, 1], 12 each, interleaved."""
    q = np.clip((x + 1) * 2048, 0, 4095).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(11, -1, -1):
        for axis in range(x.shape[1]):
            out = out << 1 | q[:, axis] >> bit & 1
    return out


def placed(distinct: DataFrame, models: dict, width: float) -> DataFrame:
    """``distinct`` with its ``dim``, ``cell`` and order in it."""

    def run(batches):
        for batch in batches:
            dims = np.zeros(batch.num_rows, np.int32)
            cell, order = np.zeros((2, batch.num_rows), np.int64)
            for dim, (at, x) in by_length(batch.column("vec")):
                dims[at] = dim
                axes, wide, spread = models.get(dim, (None, [], []))
                if axes is not None:
                    turned = units(x) @ axes
                    for k, axis in enumerate(wide):
                        if spread[axis] > width / 2:
                            cell[at] += (np.floor(turned[:, axis] / width).astype(np.int64) + (1 << SHIFT - 1)) << SHIFT * k
                    order[at] = morton(turned[:, wide[: max(1, min(4, dim))]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(order)], names=[*batch.schema.names, "dim", "cell", "morton"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(run, f"{fields}, dim int, cell bigint, morton bigint")


def tiles(distinct: DataFrame, models: dict, threshold: float) -> DataFrame:
    """One row per tile: its vectors, the box around them, and the links inside it."""
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    order = ["label", "dim", "cell", "morton", "h1", "h2"]
    ready = placed(distinct, models, width).repartitionByRange(parts(distinct.sparkSession), *order).sortWithinPartitions(*order)
    label = distinct.schema["label"].dataType
    scale = {dim: m[0] for dim, m in models.items()}

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        held: list = []  # slices of one label, length and cell

        def flush():
            nonlocal number, held
            if not held:
                return None
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
            x = t.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            dim = x.shape[1]
            side = Side(x, scale.get(dim))
            i, j = linked_pairs(side, side, threshold)
            root, _ = forest(i[i < j], j[i < j], t.num_rows)
            n = t.column("n").to_numpy()
            # A vector always links with its own copies.
            inside = np.bincount(i[i != j], n[j[i != j]], t.num_rows).astype(np.int64) + n - 1
            box = side.turned[:, :LEAD]
            row = {
                "tile": number, "dim": dim, "cell": t.column("cell")[0].as_py(), "vecs": x.tobytes(), "n": n, "inside": inside, "root": root,
                "low": t.column("low").to_pylist(), "h1": t.column("h1").to_numpy(), "h2": t.column("h2").to_numpy(), "lo": box.min(axis=0), "hi": box.max(axis=0),
            }
            number += 1
            types = {"tile": pa.int64(), "dim": pa.int32(), "cell": pa.int64(), "vecs": pa.binary(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()), "low": pa.list_(t.schema.field("low").type)}
            arrays = [pa.array([v], types.get(c, pa.list_(pa.int64()))) for c, v in row.items()]
            return pa.RecordBatch.from_arrays([t.column("label").slice(0, 1), *arrays], names=["label", *row])

        last, rows = None, 0
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("label", "dim", "cell")]))
            start = 0
            for at in range(batch.num_rows + 1):
                full = at < batch.num_rows and rows + at - start >= max(16, min(TILE, TILE_VALUES // keys[at][1]))
                if at == batch.num_rows or full or keys[at] != last:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                        rows += at - start
                    start = at
                    if at < batch.num_rows:
                        out = flush()
                        if out is not None:
                            yield out
                        rows, last = 0, keys[at]
        out = flush()
        if out is not None:
            yield out

    ids = distinct.schema["low"].dataType.simpleString()
    return ready.mapInArrow(run, (
        f"label {label.simpleString()}, tile bigint, dim int, cell bigint, vecs binary, n array<bigint>, inside array<bigint>, root array<bigint>, "
        f"low array<{ids}>, h1 array<bigint>, h2 array<bigint>, lo array<double>, hi array<double>"
    ))


def tile_pairs(cut: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` in both orders: other tiles of the same label and length that may hold links."""
    slim = cut.select("label", "dim", "cell", "tile", "lo", "hi")
    near = F.explode(F.array(*[F.lit(sum(o << SHIFT * k for k, o in enumerate(step))).cast("long") for step in product((-1, 0, 1), repeat=AXES)]))
    left = slim.select("label", "dim", F.col("tile").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), "cell", near.alias("step"))
    left = left.withColumn("cell", F.col("cell") + F.col("step")).drop("step")
    right = slim.select("label", "dim", F.col("tile").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), "cell")
    both = left.join(right, ["label", "dim", "cell"]).where("a <> b")
    behind, ahead = (F.zip_with(x, y, lambda p, q: p - q) for x, y in (("alo", "bhi"), ("blo", "ahi")))
    gap = F.zip_with(behind, ahead, lambda p, q: F.greatest(p, q, F.lit(0.0)))
    distance = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    return both.where(distance <= 2 - 2 * threshold + 1e-6).select("a", "b")


def across(cut: DataFrame, models: dict, threshold: float, element: str) -> DataFrame:
    """``node, links, other``: links of a node to other tiles, or (with ``other``) a link that joins two components of two tiles."""
    pairs = stash(tile_pairs(cut, threshold), "tile-pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(11)), F.col("groups")).alias("part"))
    bodies = cut.select("tile", "dim", "vecs", "n", "root")
    left = dealt.select("a", "part").distinct().join(bodies, F.col("a") == F.col("tile"))
    left = left.select(*[F.col(c).alias(c) for c in ("a", "part", "dim", "vecs", "n", "root")])  # names of its own beside the other side
    right = dealt.join(bodies, F.col("b") == F.col("tile")).drop("tile", "dim")
    kind = np.dtype(element)
    scale = {dim: m[0] for dim, m in models.items()}

    def side(table: pa.Table, row: int, dim: int) -> tuple[Side, np.ndarray, np.ndarray]:
        x = np.frombuffer(table["vecs"][row].as_buffer(), kind).reshape(-1, dim)
        return Side(x, scale.get(dim)), table["n"][row].values.to_numpy(), table["root"][row].values.to_numpy()

    def compare(one: pa.Table, others: pa.Table) -> pa.Table:
        dim, a = one["dim"][0].as_py(), one["a"][0].as_py()
        mine, n, root = side(one, 0, dim)
        counts, ends = np.zeros(len(n), np.int64), []
        for row in range(others.num_rows):
            b = others["b"][row].as_py()
            theirs, m, top = side(others, row, dim)
            i, j = linked_pairs(mine, theirs, threshold)
            counts += np.bincount(i, m[j], len(n)).astype(np.int64)
            if a < b and len(i):
                # Only components of the two tiles are joined, each pair of them once.
                _, kept = forest(root[i], top[j] + len(n), len(n) + len(m))
                ends += [((a << ROW_BITS) + x, (b << ROW_BITS) + y - len(n)) for x, y in kept]
        some = np.nonzero(counts)[0]
        nodes = np.concatenate([(a << ROW_BITS) + some, np.array([x for x, _ in ends], np.int64)])
        other = pa.array([*[None] * len(some), *[y for _, y in ends]], pa.int64())
        return pa.table([pa.array(nodes), pa.array(np.concatenate([counts[some], np.zeros(len(ends), np.int64)])), other], names=["node", "links", "other"])

    groups = left.groupBy("a", "part").cogroup(right.groupBy("a", "part"))
    return groups.applyInArrow(compare, "node bigint, links bigint, other bigint")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    widened = df.schema[embedding].dataType.elementType.simpleString() != "float"
    vec = F.col(embedding).cast("array<double>") if widened else F.col(embedding)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), vec.alias("vec"))
    good = rows.where(F.col("label").isNotNull() & usable(F.col("vec")))
    marks = [F.xxhash64(F.lit(i), "vec").alias(f"h{i}") for i in (1, 2)]
    distinct = good.select("*", *marks).groupBy("label", "h1", "h2").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("low"))
    distinct = stash(distinct, "vectors")
    models = principal_axes(distinct)
    cut = stash(tiles(distinct, models, threshold), "tiles")
    found = stash(across(cut, models, threshold, "f8" if widened else "f4"), "tile-links")

    whole = F.posexplode(F.arrays_zip("h1", "h2", "n", "low", "inside", "root")).alias("at", "x")
    node = lambda c: F.shiftleft("tile", ROW_BITS) + c
    nodes = cut.select("label", "tile", whole).select("label", node(F.col("at")).alias("node"), node(F.col("x.root")).alias("root"), "x.h1", "x.h2", "x.n", "x.low", "x.inside")
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    top = joined.select(F.col("node").alias("root"), F.col("comp"))
    full = nodes.join(links, "node", "left").join(top, "root", "left").select(
        "label", "h1", "h2", "n", "low", (F.col("inside") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "root").alias("comp")
    )
    full = stash(full, "vector-components")
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lowest = full.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    named = hot_join(full, lowest, ["comp"], ["h1"], "size", total[1]).select("label", "h1", "h2", "n", "n_links", "component_id")
    named = stash(named, "vector-classes")
    linked = hot_join(good.select("vec_id", "label", *marks), named, ["label", "h1", "h2"], ["vec_id"], "n", total[0]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(F.col("label").isNotNull() & usable(F.col("vec")))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
