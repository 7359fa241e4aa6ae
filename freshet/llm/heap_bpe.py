"""Byte-level BPE: merges taken from a priority queue of ranks over a doubly linked symbol list.

The vocabulary file is read once on the driver and broadcast (its size is fixed: one tokenizer).
Documents never leave their partition, so there is no shuffle and a lost executor costs only its
own tasks.  Texts are cut at single spaces into chunks whose ids do not depend on their neighbours; each
worker remembers the ids of recent chunks, and everything it forgets is computed anew.

Defined cases: a null or empty text has no ids and decodes to an empty text; strings of special
tokens inside a text become their id; ids that the vocabulary lacks are skipped by ``decode``;
columns named like an output are replaced, all others are kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from heapq import heapify
from heapq import heappop as pop
from heapq import heappush as push
from heapq import heapreplace as swap

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, extend, per_worker, ship

ship(__name__)

# Fixed value: how byte-level BPE splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space between two characters that are not white space always begins a unit of the pattern; in a run of white space it need not.
APART = re.compile(r" (?<!\s )(?!\s)")
WORDS, CHUNKS = 250_000, 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class HeapBpe:
    """One tokenizer file, ready to encode and decode."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        letters = byte_letters()
        vocab = model["vocab"]
        self.of_byte = [vocab[c] for c in letters]
        self.base = 1 + max(vocab.values())
        self.ranks, self.result = {}, []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(vocab[a] * self.base + vocab[b], rank)
            self.result.append(vocab[a + b])
        byte_of = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.pieces[i] = token.encode()
        self.strings = pa.array(self.pieces, pa.large_binary())
        self.special = {t: self.packed([i]) for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None
        self.split = regex.compile(PATTERN).findall
        self.words = Memo(self.word, WORDS, lambda w: len(w) < 64)
        self.chunks = Memo(self.spaced, CHUNKS, lambda p: "\n" not in p and len(p) < 64)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def merged(self, s: list[int]) -> list[int]:
        """Apply merges lowest rank first, leftmost among equals.

        The queue holds ``rank * n + position``; ``now`` has the rank of the pair that starts at each
        position, and an entry that no longer agrees with it is stale.
        """
        n, base, rank_of, result = len(s), self.base, self.ranks.get, self.result
        if n < 2:
            return s
        now = [rank_of(a * base + b, -1) for a, b in zip(s, s[1:])]
        queue = [r * n + i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return s
        if n == 2:
            return [result[now[0]]]
        now.append(-1)
        if len(queue) > 1:
            heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = queue[0]
            i = top % n
            rank = top // n
            if now[i] != rank:
                pop(queue)
                continue
            j = after[i]
            new = s[i] = result[rank]
            s[j] = now[j] = -1
            k = after[i] = after[j]
            r = -1
            if k < n:
                before[k] = i
                r = rank_of(new * base + s[k], -1)
            now[i] = r
            # The merged pair leaves the queue as its successor enters.
            if r >= 0:
                swap(queue, r * n + i)
            else:
                pop(queue)
            h = before[i]
            if h >= 0:
                r = now[h] = rank_of(s[h] * base + new, -1)
                if r >= 0:
                    push(queue, r * n + h)
        return [x for x in s if x >= 0]

    def word(self, w: str) -> bytes:
        of = self.of_byte
        return self.packed(self.merged([of[b] for b in w.encode()]))

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def spaced(self, chunk: str) -> bytes:
        return self.plain(" " + chunk)

    def run(self, text: str) -> bytes:
        first, *rest = APART.split(text)
        return self.plain(first) + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.run(text)
        return b"".join(self.special.get(t) or self.run(t) for t in self.cut.split(text) if t)

    def decode(self, ids: np.ndarray) -> bytes:
        known = ids[(ids >= 0) & (ids < len(self.pieces))]
        return b"".join(map(self.pieces.__getitem__, known.tolist())).decode("utf-8", "replace").encode()


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _tokenizer(spec) -> HeapBpe:
    return per_worker("heap_bpe", lambda: HeapBpe(spec.value), spec.value)


def _encoded(bpe: HeapBpe, texts: pa.Array) -> pa.ListArray:
    out = [bpe.encode(t) if t else b"" for t in texts.to_pylist()]
    ends = np.cumsum([0, *[len(x) // 4 for x in out]]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), "<i4")))


def _decoded(bpe: HeapBpe, column: pa.ListArray) -> pa.Array:
    """The vocabulary strings of all ids of a batch in one run, cut where texts end."""
    ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    known = (ids >= 0) & (ids < len(bpe.pieces))
    ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
    if not known.all():
        ends, ids = np.append(0, np.cumsum(known))[ends], ids[known]
    taken = bpe.strings.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], "<i8")[ends] if len(ids) else ends
    whole = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at.astype("<i8")), taken.buffers()[2] or pa.py_buffer(b"")])
    try:
        return whole.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that end inside a character
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def _added(df: DataFrame, tokenizer: str, fields: list[tuple[str, str]], fn: Callable[[HeapBpe, pa.RecordBatch], list]) -> DataFrame:
    spec = _shared(df.sparkSession, tokenizer)

    def make():
        bpe = _tokenizer(spec)
        return lambda batch: fn(bpe, batch)

    return extend(df, fields, make)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids array<int>``: the token ids of a text column."""
    return _added(df, tokenizer, [(ids, "array<int>")], lambda bpe, batch: [_encoded(bpe, batch.column(text))])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``decoded string``: the vocabulary strings of the ids, concatenated."""
    return _added(df, tokenizer, [(text, "string")], lambda bpe, batch: [_decoded(bpe, batch.column(ids))])


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What ``encode`` and then ``decode`` add, by one Python worker a task instead of two, each with a tokenizer."""

    def both(bpe, batch):
        made = _encoded(bpe, batch.column(text))
        return [made, _decoded(bpe, made)]

    return _added(df, tokenizer, [(ids, "array<int>"), (decoded, "string")], both)
