"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The binary Golay code is perfect:
each 23-bit word lies within 3 bits of one codeword.  A word's codes are the codewords within 4 bits
of it (one, or six if the nearest is 3 away); two words at distance 2 or less always share a code.
Four differing bits fall on the segments in one of two ways, and each gives keys of about 35 bits:

* some segment has none: then another has at most 2, so the first segment itself with a code of the
  second is a common key (six ordered pairs of segments);
* every segment has at least one: then two have exactly 1 and the third at most 2.  Of each of the
  two, one half is untouched, so two halves with a code of the third are a common key.

That makes about 96 keys per fingerprint, joined on equality and verified bit by bit.

Work is done on distinct fingerprints, so exact copies cost one row.  Components are found with
``components.linked``, which loses no link and emits no group's pairs.

Defined cases: a text that is null, empty or all white space has fingerprint zero and is linked
like any other; ``groups`` keeps repeated rows, and null ids get a component id from the others of
their group, null if there are none; ``deduplicate`` keeps one row of each component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from .common import extend, parts, per_worker, raw, release, ship, stash
from .components import linked

ship(__name__)

# The generator polynomial of the binary Golay code, and the hash seed of shingles.
GENERATOR = 0b101011100011
SEED = 42
WORDS, BITS = 4, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Bit i is set if it is set in more than half of the shingle hashes (repeats count)."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(w) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):  # sums of bytes stay below 256
        ones += np.add.reduce(np.unpackbits(h[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _syndrome(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


class Golay:
    """Tables built from the generator: syndromes of bytes, and error patterns of each syndrome."""

    def __init__(self):
        self.byte = np.array([[_syndrome(b << s & 0x7FFFFF) for b in range(256)] for s in (0, 8, 16)], np.int64)
        self.errors = np.zeros((2048, 6), np.int64)
        self.count = np.zeros(2048, np.int64)
        one = [_syndrome(1 << i) for i in range(23)]
        for weight in range(5):
            for at in combinations(range(23), weight):
                s, e = 0, 0
                for i in at:
                    s, e = s ^ one[i], e | 1 << i
                self.errors[s, self.count[s]] = e
                self.count[s] += 1

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword numbers (n, 6) near each 23-bit word, and how many of the six are in use."""
        s = self.byte[0][x & 255] ^ self.byte[1][x >> 8 & 255] ^ self.byte[2][x >> 16]
        return (x[:, None] ^ self.errors[s]) >> 11, self.count[s]


def bucket_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, and the row each belongs to."""
    segment = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    codes = [golay.keys(x) for x in segment]
    halves = [(x & (1 << n // 2) - 1, x >> n // 2) for x, (_, n) in zip(segment, SEGMENTS)]
    exact = [(x, j) for i, x in enumerate(segment) for j in range(3) if j != i]
    exact += [(x << 12 | y, 3 - i - j) for i, j in combinations(range(3), 2) for x in halves[i] for y in halves[j]]
    rows, keys = [], []
    for kind, (fixed, other) in enumerate(exact):
        code, count = codes[other]
        used = np.arange(6) < count[:, None]
        keys.append((kind << 40 | fixed[:, None] << 12 | code)[used])
        rows.append(np.nonzero(used)[0])
    return np.concatenate(keys), np.concatenate(rows)


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Add ``fp bigint``: the fingerprint as a signed number."""

    def make():
        release()
        return lambda batch: [pa.array(np.array([fingerprint(t, words) for t in raw(batch.column(text))], "<u8").view("<i8"))]

    return extend(df, [("fp", "bigint")], make)


def candidate_keys(distinct: DataFrame) -> DataFrame:
    """``key, node`` for distinct fingerprints ``fp``."""

    def run(batches):
        golay = per_worker("golay", Golay)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                keys, rows = bucket_keys(part.view("<u8"), golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "node"])

    # Keys are many times the fingerprints, so these are spread first; another hash keeps the step apart from the grouping before it.
    return distinct.select("fp").repartition(parts(distinct.sparkSession), F.xxhash64("fp")).mapInArrow(run, "key bigint, node bigint")


def near(pairs: DataFrame, bits: int = BITS) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def _named(prints: DataFrame, first: Column, bits: int) -> DataFrame:
    """``fp, first, comp``: every distinct fingerprint with the least ``first`` of its rows, and its component (null: alone)."""
    if not 0 <= bits <= BITS:
        raise ValueError("the segment keys find links of up to 4 differing bits")
    distinct = stash(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("rows")), "golay-distinct")
    comps = linked(candidate_keys(distinct), lambda pairs: near(pairs, bits).distinct(), "golay")
    return distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "first", "rows", "comp")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; rows of one component are near-duplicates of each other."""
    prints = stash(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "prints")
    named = stash(_named(prints, F.col("doc_id"), bits), "golay-named")
    together = named.where("comp IS NOT NULL")
    lowest = together.groupBy("comp").agg(F.min("first").alias("low"), F.count("*").alias("rows"))
    total = prints.count()
    # A fingerprint without a link is its own component; of the others, one component may hold most.
    of = hot_join(together.select("fp", "comp"), lowest, ["comp"], ["fp"], "rows", total).select(F.col("fp").alias("_fp"), "low")
    ids = named.join(of, F.col("fp") == F.col("_fp"), "left").select("fp", "rows", F.when(F.col("comp").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"))
    return hot_join(prints, stash(ids, "golay-ids"), ["fp"], ["doc_id"], "rows", total).select("doc_id", "fp", "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row of every component: the smallest id, null ids last; among equal ids the smallest hash of the whole row.

    A row is known by two 64-bit hashes of all its columns, so an id that repeats with other texts loses
    nothing; rows that are equal in every column count as one.
    """
    marks = [F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in df.columns]).alias(f"h{i}") for i in (1, 2)]
    prints = fingerprints(df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *marks)).select("id", "h1", "h2", "fp")
    named = _named(stash(prints, "prints"), F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2"), bits)
    winners = named.groupBy(F.coalesce("comp", "fp")).agg(F.min("first").alias("w")).select("w.h1", "w.h2")
    # Copies of a whole row are brought down to one inside each task, before anything moves.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *marks).groupBy("h1", "h2").agg(F.first("row").alias("row"))
    return rows.join(winners, ["h1", "h2"], "left_semi").select("row.*")
