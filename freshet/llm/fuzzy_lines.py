"""Line deduplication that also catches near copies: MinHash, banding, exact check, union-find.

Lines are compared by their sets of 5-character shingles.  126 minima of shingle hashes form 21
bands of 6; lines that agree in a band are candidates (a pair at similarity 0.8 is found with
probability 0.998, at 0.9 practically always).  Shorter bands would need fewer keys, but unrelated lines
then agree so often that candidates grow faster than the input.  Candidates are confirmed on their texts: Jaccard
similarity of the exact shingle sets of 0.8 or more.  ``components.linked`` joins them without listing a
group's pairs: what is left of crowded buckets is compared in blocks inside tasks, from which only links
come out.  Of each component the first occurrence (smallest document, then position) stays.

Most candidates are far from similar, so marks go before texts: 512 bits, each the parity of the line's distinct
shingle hashes that fall on it.  Every differing bit needs a shingle that only one line has, and similar
lines differ in at most a ninth of their shingles together, so no similar pair is ruled out (``near_marks``).

A line is its text without white space at the ends, known by its 64-bit hash; blank lines are left
alone.  Sketches travel as numbers; of the texts only those of candidate lines move.  Lines that
recur in very many documents are spread over salted parts when decisions are joined back.

Defined cases: null texts stay null; texts without a repeated line come back unchanged; lines
shorter than a shingle are compared whole; of rows equal in id and text one counts as the first and the
others lose all their lines; rows without an id sort first; all columns are kept, and only the text changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from .common import Memo, parts, pieces, release, ship, stash
from .components import linked

ship(__name__)

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 21, 6, 0.8
SEED = 42  # of the line hash, as in Spark's xxhash64
SEEN = 50_000
BLOCK = 512  # lines of a bucket that are compared in one piece
WORDS = 8  # 64-bit words of a line's mark
MOST_WORDS = 128  # of the wider marks of long lines, which are made and used inside tasks
TOGETHER = 256  # pairs that are verified at once
FEW = 64  # pairs that are compared one by one
TILE = 1 << 16  # shingle hashes that stay in the processor's cache
BROADCAST_ROWS = 1_000_000
CHUNK = 4096  # copies of one row that a task writes out


def coefficients(n: int) -> np.ndarray:
    """Odd multipliers of the hash functions, from a fixed generator."""
    return np.random.default_rng(7).integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA6B)
    return h ^ h >> np.uint32(15)


def run_hashes(points: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A 32-bit hash of every run of k code points, from runs of half the length."""
    h, size = _mix(points, points >> np.uint32(3)), 1
    while size < k:
        step = min(size, k - size)  # the last two runs may overlap
        h, size = _mix(h[:-step], h[step:]), size + step
    return h


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> np.ndarray:
    """One 64-bit key per line and band; many lines are hashed as one text and minima taken from line to line."""
    a = coefficients(bands * rows)
    whole = [s if len(s) >= k else s.ljust(k, "\0") for s in lines]
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    runs = size - k + 1
    h = run_hashes(np.frombuffer("".join(whole).encode("utf-32-le"), "<u4"), k)
    if len(lines) > 1:  # runs across the end of a line are left out
        h = np.delete(h, (np.cumsum(size)[:-1, None] - np.arange(1, k)).reshape(-1))
    ends = np.cumsum(runs)
    keys = np.zeros((len(lines), bands), np.uint64)
    start, first = 0, 0
    while start < len(lines):
        end = max(start + 1, int(np.searchsorted(ends, first + TILE, "right")))
        table, at = h[first : ends[end - 1]], ends[start:end] - runs[start:end] - first
        x = np.empty_like(table)
        for band in range(bands):
            key = np.full(end - start, band + 1, np.uint64)
            for j in range(band * rows, (band + 1) * rows):
                np.multiply(table, a[j], out=x)
                key = (key ^ np.minimum.reduceat(x, at)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[start:end, band] = key
        start, first = end, int(ends[end - 1])
    return keys.view(np.int64)


def marks(lines: list[str], words: int = WORDS, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Runs of k characters of every line, and the parities (n, words) of its distinct run hashes per bit."""
    whole = [s if len(s) >= k else s.ljust(k, "\0") for s in lines]
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    runs = size - k + 1
    h = run_hashes(np.frombuffer("".join(whole).encode("utf-32-le"), "<u4"), k)
    row = np.repeat(np.arange(len(lines)), runs)
    at = np.arange(len(row)) + row * (k - 1)  # runs across the end of a line are left out
    one = np.sort(row.astype(np.uint64) << np.uint64(32) | h[at])
    one = one[np.concatenate(([True], one[1:] != one[:-1]))]
    bit = (one & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    slot = (one >> np.uint64(32)) * np.uint64(64 * words) + bit % np.uint64(64 * words)
    odd = np.zeros(len(lines) * 64 * words, np.uint8)
    np.add.at(odd, slot.astype(np.int64), np.uint8(1))  # the last bit stays right beyond 255
    return runs, np.packbits(odd.reshape(len(lines), -1) & 1, axis=1).view("<u8")


def wide_marks(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Marks with about two bits for every shingle of the longest line, within bounds."""
    words = WORDS
    while words < MOST_WORDS and 64 * words < 2 * max(map(len, lines)):
        words *= 2
    return marks(lines, words)


def near_marks(gap, runs):
    """False only if two lines can't be similar: ``gap`` bits differ, ``runs`` is the sum of their runs.

    With a similarity of s, the shingles of one line alone are at most (1 - s) / (1 + s) of all shingles of both.
    """
    return gap * 9 <= runs


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def similar(x: set[str], y: set[str], least: float = SIMILARITY) -> bool:
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both)


def similar_pairs(x: list[str], y: list[str], least: float = SIMILARITY, k: int = SHINGLE) -> np.ndarray:
    """``similar`` of the shingles of many pairs of lines, all counted in one sorted run of numbers.

    A number holds the pair, the shingle (its characters by their place among all that occur) and the side.
    """
    lines = [line for pair in zip(x, y) for line in pair]
    points = np.frombuffer("".join(s if len(s) >= k else s.ljust(k, "\0") for s in lines).encode("utf-32-le"), "<u4")
    there = np.zeros(int(points.max(initial=0)) + 1, bool)
    there[points] = True
    bits, size = int(there.sum()).bit_length(), np.fromiter(map(len, lines), np.int64, len(lines))
    if k * bits + len(lines).bit_length() > 64:  # too many different characters for 64 bits
        return np.array([similar(shingles(a, k), shingles(b, k), least) for a, b in zip(x, y)], bool)
    place = np.cumsum(there).astype(np.uint64)[points]  # from 1 on
    ends = np.cumsum(np.maximum(size, k))
    for i in np.flatnonzero(size < k).tolist():
        place[ends[i] - k + size[i] : ends[i]] = 0  # no character: such lines equal only themselves
    row = np.repeat(np.arange(len(lines)), np.maximum(size - k, 0) + 1)
    at = np.arange(len(row)) + row * (k - 1)  # runs across the end of a line are left out
    key = (row >> 1).astype(np.uint64)
    for j in range(k):
        key = key << np.uint64(bits) | place[at + j]
    key = np.sort(key << np.uint64(1) | (row & 1).astype(np.uint64))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    pair = (key >> np.uint64(k * bits + 1)).astype(np.int64)
    both = np.bincount(pair[1:][key[1:] ^ key[:-1] == 1], minlength=len(x))
    return both >= least * (np.bincount(pair, minlength=len(x)) - both)


def _by_line(docs: DataFrame, make, schema: str) -> DataFrame:
    """``node`` and what ``make`` gives for every line; a task leaves out lines that it has met just before."""
    names = ["node", *[part.split()[0] for part in schema.split(", ")]]

    def run(batches):
        release()
        for batch in batches:
            seen = Memo(lambda line: True, SEEN)
            for piece in pieces(batch, 1 << 20):
                lines = []
                for text in piece.column(0).to_pylist():
                    for line in (text or "").split("\n"):
                        line = line.strip(WHITE)
                        if line and line not in seen:
                            seen[line]
                            lines.append(line)
                if lines:
                    node = np.array([xxhash.xxh64_intdigest(s.encode(), SEED) for s in lines], "<u8").view("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(node), *make(lines)], names=names)

    return docs.select("text").mapInArrow(run, f"node bigint, {schema}")


def _sketches(docs: DataFrame) -> DataFrame:
    """``node, keys`` of every line."""

    def keys(lines):
        k = band_keys(lines)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32)), pa.array(k.reshape(-1)))]

    return _by_line(docs, keys, "keys array<bigint>")


MARKS = [f"m{i}" for i in range(WORDS)]


def _marks(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, runs, m0, ...`` of the lines named by ``nodes``."""

    def made(lines):
        runs, words = marks(lines)
        return [pa.array(runs), *[pa.array(np.ascontiguousarray(words[:, i]).view("<i8")) for i in range(WORDS)]]

    schema = ", ".join([f"{c} bigint" for c in ["runs", *MARKS]])
    return _by_line(docs, made, schema).join(nodes, "node", "left_semi").dropDuplicates(["node"])


WHITE = " \t\r\f\v"


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, pos, line`` of all lines that are not blank."""
    line = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return line.select("doc", "pos", F.trim(F.col("line"), F.lit(WHITE)).alias("line")).where("line <> ''")


def _possible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs that their marks don't rule out."""
    side = lambda x: marked.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ["runs", *MARKS]])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    gap = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in MARKS), F.lit(0))
    return both.where(near_marks(gap, F.col("a_runs") + F.col("b_runs"))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b").select("a", "b", "la", "lb")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                for lo in range(0, piece.num_rows, TOGETHER):
                    some = piece.slice(lo, TOGETHER)
                    good = similar_pairs(some.column(2).to_pylist(), some.column(3).to_pylist())
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a bigint, b bigint")


def _apart(comps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The lines outside the most frequent one, and which lines each of these has to meet.

    Two lines outside the most frequent component meet once, in the order of their components.
    """
    _, comp = np.unique(np.array(comps), return_inverse=True)
    most = np.bincount(comp).argmax()
    left = np.flatnonzero(comp != most)
    return left, (comp[None, :] == most) | (comp[left][:, None] < comp[None, :])


def candidates(comps: list[int], runs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that marks don't rule out, one end outside the most frequent component."""
    if len(comps) * len(comps) <= FEW:
        most = max(comps, key=comps.count)
        long = [int.from_bytes(w.tobytes(), "little") for w in words]
        size = runs.tolist()
        left = [i for i, c in enumerate(comps) if c != most]
        found = [
            (i, j) for i in left for j, d in enumerate(comps)
            if (d == most or comps[i] < d) and near_marks((long[i] ^ long[j]).bit_count(), size[i] + size[j])
        ]
        return np.array([i for i, _ in found], np.int64), np.array([j for _, j in found], np.int64)
    left, meet = _apart(comps)
    for row, i in enumerate(left):
        at = np.flatnonzero(meet[row])
        gap = np.bitwise_count(words[at] ^ words[i]).sum(1, dtype=np.int64)
        meet[row, at] = near_marks(gap, runs[at] + runs[i])
    i, j = np.nonzero(meet)
    return left[i], j


def spanning(lines: list[str], comps: list[int]) -> list[tuple[int, int]]:
    """Links that connect the components of some lines as far as similar pairs connect them."""
    sets: dict[int, set[str]] = {}
    up = {c: c for c in comps}
    out = []

    def find(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    def of(i: int) -> set[str]:
        if i not in sets:
            sets[i] = shingles(lines[i])
        return sets[i]

    for i, j in zip(*[x.tolist() for x in candidates(comps, *wide_marks(lines))]):
        c, d = find(comps[i]), find(comps[j])
        if c != d and similar(of(i), of(j)):
            up[c] = d
            out.append((i, j))
    return out


BLOCKS = ["key", "i", "j"]


def _grouped(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of the rows of every block (``key, i, j, node, comp`` and more), each node once; a task holds one block."""
    spark = rows.sparkSession
    ready = rows.repartition(parts(spark), *BLOCKS).sortWithinPartitions(*BLOCKS, "node")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        def done(group, out):
            once = list({r[3]: r for r in group}.values())
            if len(once) > 1:
                out += make(once)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(len(names))], names=names)

        held: list = []
        for batch in batches:
            out: list = []
            for piece in pieces(batch):
                for row in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in piece.columns]):
                    if held and held[-1][:3] != row[:3]:
                        done(held, out)
                        held = []
                    held.append(row)
            yield batch_of(out)
        if held:
            out = []
            done(held, out)
            yield batch_of(out)

    return ready.mapInArrow(run, schema)


def _across(mixed: DataFrame, marked: DataFrame, texts) -> DataFrame:
    """Links between components of the same bucket, found inside tasks: a bucket's pairs never become rows.

    A bucket's lines are cut by hash into blocks of about ``BLOCK`` and dealt as pairs of blocks, so
    a task holds two blocks at most and a hot bucket is spread; a bucket of that size is dealt once, as one block.
    A larger one's main component has blocks of its own, which meet the other lines' blocks but not each other.  Blocks are compared by marks first, and only lines
    with a possible partner come back with their texts.
    """
    zero = F.lit(0).cast("bigint")
    other, most = F.ceil(F.col("rest") / BLOCK), F.ceil((F.col("size") - F.col("rest")) / BLOCK)
    outside, small = F.col("comp") != F.col("main"), F.col("size") <= BLOCK
    own = F.when(small, zero).when(outside, F.pmod(F.xxhash64("node"), other)).otherwise(other + F.pmod(F.xxhash64("node"), most))
    last = F.when(small, zero).when(outside, other + most - 1).otherwise(other - 1)
    # Marks are joined before the rows are dealt out: a bucket member once, however many blocks it meets.
    full = mixed.join(marked, "node")
    dealt = full.select("key", "node", "comp", "runs", *MARKS, own.alias("own"), F.explode(F.sequence(zero, last)).alias("with"))
    dealt = dealt.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "comp", "runs", *MARKS)

    def possible(rows):
        words = np.array([r[6:] for r in rows], "<i8").view("<u8")
        found = candidates([r[4] for r in rows], np.array([r[5] for r in rows]), words)
        return [rows[x][:5] for x in np.unique(np.concatenate(found)).tolist()]

    def links(rows):
        return [(rows[i][3], rows[j][3]) for i, j in spanning([r[5] for r in rows], [r[4] for r in rows])]

    some = stash(_grouped(dealt, possible, "key bigint, i bigint, j bigint, node bigint, comp bigint"), "line-possible")
    ready = some.join(texts(some.select("node")), "node").select(*BLOCKS, "node", "comp", "line")
    return _grouped(ready, links, "a bigint, b bigint").distinct()


def line_groups(docs: DataFrame) -> DataFrame:
    """``node, comp`` of lines that have a near copy; ``docs`` is ``doc, text``."""
    members = _sketches(docs).select(F.explode("keys").alias("key"), "node")
    marked: list[DataFrame] = []

    def known(nodes: DataFrame) -> DataFrame:
        wanted = stash(nodes.distinct(), "line-nodes")
        # 8 bytes each; beyond that, a shuffled join
        return F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def texts(nodes: DataFrame) -> DataFrame:
        lines = _lines(docs).select(F.xxhash64("line").alias("node"), "line").join(known(nodes), "node", "left_semi")
        return stash(lines.groupBy("node").agg(F.min("line").alias("line")), "line-texts")

    def verify(candidates: DataFrame) -> DataFrame:
        pairs = stash(candidates.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "line-pairs")
        # Every member of a crowded bucket is an end of a pair, so these are all marks that are needed.
        marked.append(stash(_marks(docs, known(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))), "line-marks"))
        left = stash(_possible(pairs, marked[0]), "line-possible-pairs")
        return _verified(left, texts(left.select(F.col("a").alias("node")).union(left.select("b"))))

    def across(mixed: DataFrame) -> DataFrame:
        return _across(mixed, marked[0], texts)

    return linked(members, verify, "lines", across)


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, their texts without the lines that have an earlier copy or near copy.

    A document whose lines all go keeps an empty text.
    """
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie"))
    docs = df.select(key.alias("doc"), F.col(text).alias("text"))
    at = stash(_lines(docs).select(F.struct("doc", "pos").alias("at"), F.xxhash64("line").alias("node")), "line-places")
    lines = at.groupBy("node").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    comps = line_groups(docs)
    placed = lines.join(comps, "node", "left").select("node", "first", "n", F.coalesce("comp", "node").alias("comp"), F.col("comp").isNotNull().alias("near"))
    # Only lines that occur again, or have a near copy, decide anything.
    placed = stash(placed.where("n > 1 OR near"), "line-placed")
    kept = placed.where("near").groupBy("comp").agg(F.min("first").alias("kept"))
    # A component may hold a large share of the lines, so its members are spread.
    grouped = salted_join(placed.where("near").select("node", "comp"), kept, ["comp"], ["node"]).select("node", "kept")
    decided = stash(grouped.union(placed.where("NOT near").select("node", F.col("first").alias("kept"))), "line-decisions")
    gone = salted_join(at, decided, ["node"], ["at"]).where("at <> kept").select("at.doc", "at.pos")
    drops = gone.groupBy("doc").agg(F.collect_set("pos").alias("_drop"))
    # The row travels as one struct, so its column names cannot clash with ours.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("doc"))
    repeated = stash(docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "line-repeats")
    late = None
    if not repeated.isEmpty():
        rows, late = _first_rows(rows, repeated)
    joined = rows.join(drops, "doc", "left")
    own = lambda c: F.col("row").getField(c)
    lines = F.split(own(text), "\n", -1)
    shown = lambda t: [(t if c == text else own(c)).alias(c) for c in df.columns]
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_drop", i)), "\n")
    slim = joined.select(*shown(F.when(F.col("_drop").isNull(), own(text)).otherwise(left)))
    if late is None:
        return slim
    blank = F.array_join(F.filter(lines, lambda line: F.trim(line, F.lit(WHITE)) == ""), "\n")
    return slim.union(late.select(*shown(blank)))


def _first_rows(rows: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that count as the first of their id and text, and the later ones, whose lines all have an earlier copy.

    Rows equal in every column are counted inside tasks; which of the others is first is settled by their hashes.
    """
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    known = repeated.select(F.col("doc").alias("_doc"))
    marked = rows.join(known, same, "left_semi").select("doc", "row", *[F.xxhash64(F.lit(i), "row").alias(f"h{i}") for i in (1, 2)])
    kinds = stash(marked.groupBy("doc", "h1", "h2").agg(F.first("row").alias("row"), F.count("*").alias("n")), "line-kinds")
    first = kinds.groupBy("doc").agg(F.min(F.struct("h1", "h2")).alias("w")).select(F.col("doc").alias("_doc"), "w")
    led = kinds.join(first, same).withColumn("leads", F.struct("h1", "h2") == F.col("w"))
    times = F.col("n") - F.col("leads").cast("long")
    # Many copies of one row are written out in chunks, dealt over all tasks.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / CHUNK)))
    late = led.where(times > 0).select("doc", "row", times.alias("times"), chunk.alias("chunk")).repartition(parts(rows.sparkSession), "doc", "chunk")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK), F.col("times") - F.col("chunk") * CHUNK)))
    return rows.join(known, same, "left_anti").union(led.where("leads").select("row", "doc")), late.select("row", each.alias("i")).drop("i")
