"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every benchmark text gives windows of 13 consecutive words (a shorter one gives a single window).
Texts and windows are brought to one form, their words between single spaces, so that a window
occurs exactly where its bytes occur.  A shift table over byte blocks tells how far the search may
jump; where the shift is zero, the bucket of that block (the last one of the pattern prefix) lists
the patterns to compare directly.  Patterns of similar length share tables, so short items do not
shorten the jumps of long ones.

Documents stay in their partition: no shuffle, and a lost task is simply run again.  Benchmark
texts are broadcast in blocks of at most ``BLOCK_BYTES`` (a larger text is a block of its own);
a larger benchmark takes several passes over the documents inside the same stage, and the driver
holds one block at a time.

Defined cases: null and empty texts have no words and no hits; items without words give no window;
items with equal windows are all reported; repeated rows are judged alike; columns named like an
output are replaced.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, per_worker, raw, ship

ship(__name__)

WINDOW = 13
BLOCK_BYTES = 1 << 20
# Lower-cases A-Z; everything that is not 0-9, a-z or above 0x7F becomes a space.
FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FORM).split()


class Tables:
    """Shift table and suffix buckets of patterns that share one prefix length."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        # The usual choice: blocks long enough that most of them occur in no pattern.
        self.block = size = max(1, min(m, math.ceil(math.log(max(2, 2 * m * len(patterns)), 5))))
        self.jump = m - size + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for q in range(size, m + 1):
                b = p[q - size : q]
                if m - q < self.shift.get(b, self.jump):
                    self.shift[b] = m - q
            self.bucket.setdefault(p[m - size : m], []).append(p)

    def find(self, text: bytes):
        """(start, pattern) of every occurrence."""
        m, size, jump, n = self.m, self.block, self.jump, len(text)
        shift, end = self.shift.get, self.m
        while end <= n:
            b = text[end - size : end]
            step = shift(b, jump)
            if step:
                end += step
                continue
            for p in self.bucket[b]:
                if text.startswith(p, end - m):
                    yield end - m, p
            end += 1


class Search:
    """All windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.owners: dict[bytes, set[str]] = {}
        self.size: dict[bytes, int] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                part = w[i : i + window]
                p = b" " + b" ".join(part) + b" "
                self.owners.setdefault(p, set()).add(item)
                self.size[p] = len(part)
        classes: dict[int, list[bytes]] = {}
        for p in self.owners:
            classes.setdefault(min(5, len(p).bit_length() - 1), []).append(p)
        self.tables = [Tables(c) for c in classes.values()]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges (first, last) in order, and the items found."""
        w = words(text)
        if not w:
            return 0, [], set()
        form = b" " + b" ".join(w) + b" "
        found = [hit for t in self.tables for hit in t.find(form)]
        if not found:
            return len(w), [], set()
        gaps = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
        first = np.searchsorted(gaps, [a for a, _ in found]).tolist()
        spans = [(a, a + self.size[p] - 1) for a, (_, p) in zip(first, found)]
        return len(w), spans, set().union(*(self.owners[p] for _, p in found))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark in blocks of bounded size, one at a time."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    if n == 1:
        yield [(x.item, bytes(x.text)) for x in items.collect()]
        return
    held, size = [], 0
    for x in items.toLocalIterator():
        if held and size + len(x.text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((x.item, bytes(x.text)))
        size += len(x.text)
    yield held


def search(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``n_words``, ``spans`` (disjoint ranges of hit words, from 0) and ``items`` (sorted ids found)."""
    sc = df.sparkSession.sparkContext
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_words", "spans", "items")])
    fields = [("n_words", "bigint"), ("spans", "array<struct<first:bigint,last:bigint>>"), ("items", "array<string>")]
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
    for k, block in enumerate(_blocks(benchmark, item_id, item_text)):
        shared = sc.broadcast(block)

        def make(shared=shared, later=k > 0, k=k, version=uuid.uuid4().hex):
            tool = per_worker(f"wu_manber {k}", lambda: Search(shared.value, window), version)

            def fn(batch):
                counts, spans, items = [], [], []
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()) if later else ((None, None) for _ in range(batch.num_rows))
                for t, (old_spans, old_items) in zip(raw(batch.column(text)), before):
                    n, hit, found = tool.scan(t)
                    counts.append(n)
                    hit = union(hit + [(s["first"], s["last"]) for s in old_spans or []])
                    spans.append([{"first": a, "last": b} for a, b in hit])
                    items.append(sorted(found | set(old_items or [])))
                return [pa.array(x, kind) for x, kind in zip((counts, spans, items), kinds)]

            return fn

        out = extend(out, fields, make)
    return out


def n_hit(spans: str = "spans"):
    """Number of hit words of a document."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"] + 1)


def contaminated(n_words: str = "n_words", spans: str = "spans"):
    """At least one hit word, and at least one word in twenty."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    return search(own, benchmark).where(~contaminated()).select("row.*")
