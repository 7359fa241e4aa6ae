"""Bootstrap interval of a rank correlation for groups of any size, without a row per pair and replicate.

A resample of n pairs is a count per pair.  The counts of all replicates follow from a tree over the positions
of the sorted pairs: the draws of a node fall to its left half by a binomial draw whose generator is seeded by the
node, so any task finds the counts of its own pairs by walking down from the root, and the same ones each time.

Pairs are sorted by x into blocks, and again by y.  Each time, blocks report what all replicates draw in them
(and how much of it at their first and last value, where ties may go on in the next block), those totals are
carried along the blocks, and weighted mid-ranks of all replicates follow inside each block.  The counts and x-ranks travel
to the second order in one array per pair; at the end each block gives three sums per replicate.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import stash
from ..functions.quantiles import spearman

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N_BOOT, SEED = 2000, 1996
CELL = 512  # positions of a leaf of the tree
BLOCK = 1024  # sorted pairs of a block
FAN = 256  # parts in which the sums of blocks are added up
CHUNK = 16  # replicates whose totals are carried along in one group


def draws_before(points: np.ndarray, n: int, reps: int, seed: Sequence[int]) -> np.ndarray:
    """``(points, reps)``: how many of a replicate's n draws from positions 0..n-1 lie before each (sorted) point."""
    out = np.zeros((len(points), reps), np.int64)
    todo = [(0, -(-n // CELL), np.zeros(reps, np.int64), np.full(reps, n, np.int64))]
    while todo:
        first, last, before, count = todo.pop()
        start, stop = first * CELL, min(n, last * CELL)
        i, j = np.searchsorted(points, start), np.searchsorted(points, stop)
        if i == j:
            continue
        rng = np.random.default_rng([*seed, first, last])
        if last - first == 1:
            at = rng.integers(0, stop - start, int(count.sum()))
            hits = np.bincount(np.repeat(np.arange(reps), count) * (stop - start) + at, minlength=reps * (stop - start))
            upto = np.zeros((reps, stop - start + 1), np.int64)
            np.cumsum(hits.reshape(reps, -1), axis=1, out=upto[:, 1:])
            out[i:j] = before + upto[:, points[i:j] - start].T
            continue
        mid = (first + last) // 2
        left = rng.binomial(count, (mid * CELL - start) / (stop - start))
        todo += [(first, mid, before, left), (mid, last, before + left, count - left)]
    out[np.searchsorted(points, n) :] = n
    return out


def _seed(table: pa.Table, keys: Sequence[str], seed: int) -> list[int]:
    return [seed, zlib.crc32("|".join(str(table[c][0].as_py()) for c in keys).encode())]


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted by keys and order, with a ``block`` whose numbers follow that order; a block has one key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    ready = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def run(batches):
        block, held, last = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for batch in batches:
            own = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys])):
                if held == BLOCK or key != last:
                    block, held, last = block + 1, 0, key
                held += 1
                own[i] = block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "block"])

    return ready.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", block bigint")


def _totals(value: np.ndarray, counts: np.ndarray, block: int) -> pa.Table:
    """What a block's replicates draw at its first value, between, and at its last value."""
    low, high = value == value[0], (value == value[-1]) & (value[0] != value[-1])
    parts = [counts[m].sum(axis=0) for m in (low, ~(low | high), high)]
    chunks = range(0, counts.shape[1], CHUNK)
    fixed = [pa.array([x] * len(chunks)) for x in (block, float(value[0]), float(value[-1]))]
    sums = [pa.array([p[c : c + CHUNK].tobytes() for c in chunks], pa.binary()) for p in parts]
    return pa.table([*fixed, pa.array(list(chunks)), *sums], names=["block", "lo", "hi", "chunk", "w_lo", "w_mid", "w_hi"])


TOTALS = "block bigint, lo double, hi double, chunk bigint, w_lo binary, w_mid binary, w_hi binary"
CARRIED = ("below_lo", "tie_lo", "below_hi", "tie_hi")


def _carried(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per block: for its first and last value, the draws below it and at it in the whole group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        wide = len(table["w_lo"][0].as_py()) // 8
        read = lambda c: np.frombuffer(b"".join(table[c].to_pylist()), np.int64).reshape(-1, wide)
        parts = np.stack([read(c) for c in ("w_lo", "w_mid", "w_hi")], axis=1)
        ends = np.cumsum(parts.reshape(-1, wide), axis=0).reshape(parts.shape)
        starts = ends - parts
        lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
        # Where a block has one value only, all of it counts as its first.
        values = np.concatenate([lo, hi])
        below, tie = np.concatenate([starts[:, 0], starts[:, 2]]), np.concatenate([parts[:, 0], parts[:, 2]])
        kinds, which = np.unique(values, return_inverse=True)
        sums, first = np.zeros((len(kinds), wide), np.int64), np.full((len(kinds), wide), np.iinfo(np.int64).max)
        np.add.at(sums, which, tie)
        np.minimum.at(first, which, below)
        n = len(lo)
        out = [first[which[:n]], sums[which[:n]], first[which[n:]], sums[which[n:]]]
        return pa.table([table["block"], table["chunk"], *[pa.array([r.tobytes() for r in x], pa.binary()) for x in out]], names=["block", "chunk", *CARRIED])

    each = totals.groupBy(*keys, "chunk").applyInArrow(run, "block bigint, chunk bigint, " + ", ".join(f"{c} binary" for c in CARRIED))
    # As many entries as there are chunks of replicates.
    whole = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("chunk", *CARRIED))).alias("c"))
    return whole.select("block", *[F.col(f"c.{c}").alias(c) for c in CARRIED])


def _ranks(value: np.ndarray, counts: np.ndarray, carried: pa.Table) -> np.ndarray:
    """Twice the weighted mid-rank of every pair in every replicate."""
    below_lo, tie_lo, below_hi, tie_hi = (np.frombuffer(b"".join(carried[c][0].as_py()), np.int64) for c in CARRIED)
    start = np.nonzero(np.concatenate([[True], value[1:] != value[:-1]]))[0]
    tie = np.add.reduceat(counts, start, axis=0)
    inner = tie.copy()
    inner[0] = 0  # the first value's draws are counted in tie_lo
    below = below_lo + tie_lo + np.cumsum(inner, axis=0) - inner
    below[0], tie[0] = below_lo, tie_lo
    if len(start) > 1:
        below[-1], tie[-1] = below_hi, tie_hi
    return np.repeat(2 * below + tie + 1, np.diff([*start, len(value)]), axis=0)


def boot_spearman_ci(df: DataFrame, keys: Sequence[str], x: str, y: str, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """Rank correlation with a 95 % percentile-bootstrap interval over complete pairs.

    Every replicate draws n of a group's n pairs with replacement.  The interval depends on the set of
    pairs and the seed, not on row order or partitioning.  Groups of fewer than three pairs give no row; pairs with
    a null or non-finite side are left out; the interval is null if no replicate varies on both sides.
    """
    k = list(keys)
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    pairs = df.select(*k, finite(F.col(x).cast("double")).alias("_x"), finite(F.col(y).cast("double")).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    # Equal pairs are drawn as one, however many there are; the source is read once.
    counted = stash(pairs.groupBy(*k, "_x", "_y").agg(F.count("*").alias("_m")), "boot-pairs")
    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.select(*k).schema.fields)

    by_x = stash(_blocks(counted, k, ["_x", "_y"]), "boot-by-x")
    sizes = by_x.groupBy(*k, "block").agg(F.sum("_m").alias("size"))
    group = Window.partitionBy(*k)
    spans = stash(sizes.select("block", (F.sum("size").over(group.orderBy("block")) - F.col("size")).alias("off"), F.sum("size").over(group).alias("n")), "boot-spans")
    largest = spans.agg(F.max("n")).first()[0] or 0
    number = np.int32 if largest < 1 << 29 else np.int64
    placed = by_x.join(spans, "block")

    def drawn(table: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        table = table.sort_by([("_x", "ascending"), ("_y", "ascending")])
        n, off = table["n"][0].as_py(), table["off"][0].as_py()
        points = off + np.concatenate([[0], np.cumsum(table["_m"].to_numpy())])
        return table, np.diff(draws_before(points, n, n_boot, _seed(table, k, seed)), axis=0), n

    def named(table: pa.Table, own: pa.Table) -> pa.Table:
        for c in reversed(k):
            own = own.add_column(0, c, pa.array([table[c][0].as_py()] * own.num_rows, table.schema.field(c).type))
        return own

    def x_totals(table: pa.Table) -> pa.Table:
        table, counts, _ = drawn(table)
        return named(table, _totals(table["_x"].to_numpy(), counts, table["block"][0].as_py()))

    def rows(a: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in a.astype(number)], pa.binary())

    def x_ranks(table: pa.Table, carried: pa.Table) -> pa.Table:
        table, counts, n = drawn(table)
        ranks = _ranks(table["_x"].to_numpy(), counts, carried) - (n + 1)
        return named(table, pa.table([table["_y"], table["n"], rows(counts), rows(ranks)], names=["_y", "n", "w", "rx"]))

    def stored(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by("_y")
        return table, np.frombuffer(b"".join(table["w"].to_pylist()), number).reshape(-1, n_boot).astype(np.int64)

    def y_totals(table: pa.Table) -> pa.Table:
        table, counts = stored(table)
        return named(table, _totals(table["_y"].to_numpy(), counts, table["block"][0].as_py()))

    def y_sums(table: pa.Table, carried: pa.Table) -> pa.Table:
        table, counts = stored(table)
        b = (_ranks(table["_y"].to_numpy(), counts, carried) - (table["n"][0].as_py() + 1)).astype(float)
        a = np.frombuffer(b"".join(table["rx"].to_pylist()), number).reshape(-1, n_boot).astype(float)
        sums = [(counts * p * q).sum(axis=0) for p, q in ((a, a), (b, b), (a, b))]
        return named(table, pa.table([pa.array([table["block"][0].as_py() % FAN]), pa.array([np.stack(sums).tobytes()], pa.binary())], names=["part", "s"]))

    def added(table: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(b.as_py(), float) for b in table["s"])

    def part_sums(table: pa.Table) -> pa.Table:
        return named(table, pa.table([pa.array([added(table).tobytes()], pa.binary())], names=["s"]))

    def interval(table: pa.Table) -> pa.Table:
        aa, bb, ab = added(table).reshape(3, -1)
        rho = ab[(aa > 0) & (bb > 0)] / np.sqrt(aa * bb)[(aa > 0) & (bb > 0)]
        lo, hi = np.percentile(rho, [2.5, 97.5]).tolist() if len(rho) else (None, None)
        return named(table, pa.table([pa.array([x], pa.float64()) for x in (lo, hi)], names=["ci_lo", "ci_hi"]))

    def fresh(d: DataFrame) -> DataFrame:
        return d.select(*[F.col(c).alias(c) for c in d.columns])  # columns of its own beside a frame of the same origin

    carried_x = stash(_carried(placed.groupBy("block").applyInArrow(x_totals, f"{ids}, {TOTALS}"), k), "boot-x-carried")
    ranked = placed.groupBy("block").cogroup(fresh(carried_x).groupBy("block")).applyInArrow(x_ranks, f"{ids}, _y double, n bigint, w binary, rx binary")
    by_y = stash(_blocks(ranked, k, ["_y"]), "boot-by-y")
    carried_y = stash(_carried(by_y.groupBy("block").applyInArrow(y_totals, f"{ids}, {TOTALS}"), k), "boot-y-carried")
    sums = by_y.groupBy("block").cogroup(fresh(carried_y).groupBy("block")).applyInArrow(y_sums, f"{ids}, part bigint, s binary")
    # Two levels of sums, so that no task holds the sums of all blocks of a large group.
    ci = sums.groupBy(*k, "part").applyInArrow(part_sums, f"{ids}, s binary").groupBy(*k).applyInArrow(interval, f"{ids}, ci_lo double, ci_hi double")
    each = counted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    return spearman(each, k, "_x", "_y").where("n_pairs >= 3").join(ci, k, "left")
