"""Alignment of two tokenizers: which tokens of a byte-level vocabulary and of a piece vocabulary share bytes.

Per Arrow batch, both sides become tables of tokens with their document and first byte.  Two
``merge_asof`` by document give each token start the token of the other side that covers it; the union
of both directions is every pair of tokens whose byte ranges overlap.  Offsets at which both sides
end a token cut a document into groups.

The links of a document are written once as arrays of distinct id pairs and how often each occurs.
A pair's count, the number of documents that hold it, comes from one aggregation that is combined
inside tasks.  The ``HOT`` most frequent pairs, a fixed number of 16 bytes each, are looked up in a
broadcast; occurrences of all others are joined to their counts by a shuffle, so nothing depends on
how many pairs a corpus has.

Texts are cut at spaces between other characters; no unit of either vocabulary reaches across one,
which is checked for the piece vocabulary when it is loaded.  Each worker remembers the tokens of
recent chunks and computes anew what it forgets.

Defined cases: texts that are null or empty, and texts whose tokens do not spell exactly a space and
the text on both sides, have no tokens (all numbers zero, an empty digest); strings of special tokens
are plain text; repeated rows count as documents of their own; null ids stay; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, pieces, ship, stash
from .heap_bpe import byte_letters

ship(__name__)

BLANK = "▁"  # stands for a space in pieces
APART = re.compile(rf" (?<=[^\s{BLANK}] )(?=[^\s{BLANK}])")
CHUNKS = 250_000  # remembered by a worker, twice at most
SLICE = 1 << 21  # bytes of text that are aligned at once
HOT = 1_000_000  # pairs in the broadcast


class Pair:
    """Both vocabularies, ready to give the tokens of a text and their lengths in bytes."""

    def __init__(self, bpe: bytes, pieces_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(bpe.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces_model)
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        vocab = json.loads(bpe)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(BLANK in s.lstrip(BLANK) for s in names):
            raise ValueError("a piece goes on after a space, so texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace(BLANK, " ").encode() for i, s in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def tokens(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides for a space and each text, empty if one side does not spell it."""
        chunks = [APART.split(t) if t else [] for t in texts]
        known = self.ids({c for own in chunks for c in own})
        out = []
        for own in chunks:
            found = [known[c] for c in own]
            out.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])) if found and None not in found else (b"", b""))
        return out

    def ids(self, chunks: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of every chunk, from the two last generations of ``CHUNKS`` remembered ones or from the libraries."""
        if len(self.kept) > CHUNKS:
            self.kept, self.older = {}, self.kept
        known = {c: source[c] for source in (self.older, self.kept) for c in chunks & source.keys()}
        new = list(chunks - known.keys())
        known.update(zip(new, self.spelled(new)))
        self.kept.update((c, x) for c, x in known.items() if len(c) < 64)
        return known

    def spelled(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides for a space and each chunk, None where one side does not spell it."""
        wholes = [f" {c}" for c in chunks]
        sides = [e.ids for e in self.a.encode_batch_fast(wholes, add_special_tokens=False)], self.b.encode(chunks, num_threads=1)
        raw = [w.encode() for w in wholes]
        good, parts = np.ones(len(chunks), bool), []
        for ids, names in zip(sides, (self.a_bytes, self.b_bytes)):
            flat = [i for own in ids for i in own]
            ends = np.cumsum([0, *map(len, ids)]) * 4
            packed = np.array(flat, "<i4").tobytes()
            parts.append([packed[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())])
            sizes = [sum([len(names[i]) for i in own]) for own in ids]
            if sizes != list(map(len, raw)) or b"".join([names[i] for i in flat]) != b"".join(raw):
                good &= [b"".join([names[i] for i in own]) == w for own, w in zip(ids, raw)]
        return [x if ok else None for x, ok in zip(zip(*parts), good.tolist())]


def vocab_sizes(bpe: bytes, pieces_model: bytes) -> tuple[int, int]:
    import sentencepiece

    return 1 + max(json.loads(bpe)["model"]["vocab"].values()), sentencepiece.SentencePieceProcessor(model_proto=pieces_model).get_piece_size()


def overlaps(a_doc: np.ndarray, a_start: np.ndarray, b_doc: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of tokens that share a byte; starts run on from document to document."""
    a = pd.DataFrame({"doc": a_doc, "start": a_start, "a": np.arange(len(a_doc))})
    b = pd.DataFrame({"doc": b_doc, "start": b_start, "b": np.arange(len(b_doc))})
    covering_b = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy(np.int64)
    covering_a = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy(np.int64)
    # Tokens that begin together are found from both sides.
    late = np.nonzero(a_start[covering_a] != b_start)[0]
    return np.concatenate([np.arange(len(a_doc)), covering_a[late]]), np.concatenate([covering_b, late])


def _words(size: int, ends: str) -> np.ndarray:
    """``table[k, id]`` is the decimal id and the k-th separator, padded with zero bytes."""
    return np.array([[f"{i}{end}" for i in range(size)] for end in ends], "S")


class Aligner:
    def __init__(self, bpe: bytes, pieces_model: bytes):
        self.pair = Pair(bpe, pieces_model)
        self.sizes = len(self.pair.a_bytes), len(self.pair.b_bytes)
        self.words = _words(self.sizes[0], ",|"), _words(self.sizes[1], ",;")

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        """``n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` of some documents."""
        found = self.pair.tokens(texts)
        a_id, b_id = (np.frombuffer(b"".join([x[k] for x in found]), "<i4") for k in (0, 1))
        a_len, b_len = self.pair.a_size[a_id], self.pair.b_size[b_id]
        n = len(texts)
        n_a, n_b = (np.array([len(x[k]) // 4 for x in found], np.int64) for k in (0, 1))
        a_doc, b_doc = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        a_end, b_end = np.cumsum(a_len, dtype=np.int64), np.cumsum(b_len, dtype=np.int64)
        at_a, at_b = overlaps(a_doc, a_end - a_len, b_doc, b_end - b_len)
        doc = a_doc[at_a]
        n_links = np.bincount(doc, minlength=n)

        # Groups end where both sides end.
        both = np.zeros(1 + (int(a_end[-1]) if len(a_end) else 0), bool)
        both[a_end] = True
        closes_b = both[b_end]
        both[:] = False
        both[b_end] = True
        closes_a = both[a_end]
        n_groups = np.bincount(a_doc[closes_a], minlength=n)
        digests = self._digests(n_a, n_b, a_id, b_id, closes_a, closes_b)

        size = self.sizes[0] * self.sizes[1]
        keys, times = np.unique(doc * size + a_id[at_a].astype(np.int64) * self.sizes[1] + b_id[at_b], return_counts=True)
        offsets = pa.array(np.searchsorted(keys, np.arange(n + 1) * size).astype(np.int32))
        pairs = pa.ListArray.from_arrays(offsets, pa.array(keys % size))
        return [*[pa.array(x) for x in (n_a, n_b, n_groups, n_links)], pa.array(digests), pairs, pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]

    def _digests(self, n_a, n_b, a_id, b_id, closes_a, closes_b) -> list[str]:
        """Of ``a1,a2|b1;a3|b2,b3``: in each group the ids of one side, then those of the other."""
        ends_a, ends_b = np.cumsum(closes_a), np.cumsum(closes_b)
        group_a, group_b = ends_a - closes_a, ends_b - closes_b
        groups = int(ends_a[-1]) if len(ends_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        out = np.empty(len(a_id) + len(b_id), f"S{max(w.dtype.itemsize for w in self.words)}")
        out[np.arange(len(a_id)) + (np.cumsum(in_b) - in_b)[group_a]] = self.words[0][closes_a.astype(np.int8), a_id]
        out[np.arange(len(b_id)) + np.cumsum(in_a)[group_b]] = self.words[1][closes_b.astype(np.int8), b_id]
        stops = np.cumsum(n_a + n_b).tolist()
        spelled = (out[lo:hi].tobytes().translate(None, b"\0")[:-1] for lo, hi in zip([0, *stops], stops))
        return [hashlib.sha256(s).hexdigest() if s else "" for s in spelled]


FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def _files(spark: SparkSession, bpe: str, pieces_model: str):
    with open(bpe, "rb") as f, open(pieces_model, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def links(docs: DataFrame, bpe: str, pieces_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its numbers of tokens, groups and links, its groups' digest, and its distinct
    links ``pairs`` (A id times size of B's vocabulary plus B id) with their ``times``.  ``row`` tells rows apart."""
    spec = _files(docs.sparkSession, bpe, pieces_model)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        align = per_worker("token_alignment", lambda: Aligner(*spec.value), spec.value)
        row = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", *[f.split()[0] for f in FIELDS.split(", ")]]
        for batch in batches:
            for piece in pieces(batch, SLICE):
                rows = pa.array(np.arange(row, row + piece.num_rows))
                row += piece.num_rows
                yield pa.RecordBatch.from_arrays([rows, piece.column(0), *align(piece.column(1).to_pylist())], names=names)

    return slim.mapInArrow(run, f"row bigint, doc_id {slim.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best``: documents that hold a pair, and whether that is the most of its A id."""
    counts = stash(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    a = F.floor(F.col("pair") / size_b).alias("a")
    top = counts.groupBy(a).agg(F.max("count").alias("most"))
    # At most one row per id of the A vocabulary.
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The pairs whose count reaches the lowest power of two that at most ``limit`` pairs reach, and whether others are left."""
    level = F.floor(F.log2("count")).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect())  # at most 64 rows
    least, n = 64, 0
    for at in sorted(sizes, reverse=True):
        n += sizes[at]
        if n > limit:
            break
        least = at
    return counts.where(level >= least), n > limit


def align(docs: DataFrame, bpe: str, pieces_model: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``links`` without the arrays, and ``n_best`` and ``count_sum``: of all links, those whose count is their A id's
    highest, and the sum of their counts."""
    spark = docs.sparkSession
    with open(bpe, "rb") as f, open(pieces_model, "rb") as g:
        size_b = vocab_sizes(f.read(), g.read())[1]
    found = stash(links(docs, bpe, pieces_model, doc_id, text), "links")
    counts = stash(pair_counts(found, size_b), "pair-ranks")
    most, more = frequent(counts, hot)
    table = most.toArrow().combine_chunks().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "count", "best")))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        key, count, best = known.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").values.to_numpy()
            at = pairs.offsets.to_numpy()
            times, values = times[at[0] : at[-1]], pairs.values.to_numpy()[at[0] : at[-1]]
            at = at - at[0]
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            place = np.minimum(np.searchsorted(key, values), max(len(key) - 1, 0))
            hit = key[place] == values if len(key) else np.zeros(len(values), bool)
            sums = np.zeros((2, len(at) - 1), np.int64)
            weight = times[hit].astype(np.int64)
            np.add.at(sums[0], doc[hit], weight * best[place[hit]])
            np.add.at(sums[1], doc[hit], weight * count[place[hit]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(at) - 1))]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (values, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, sums), *rest], names=[*kept, "n_best", "count_sum", "rest", "rest_times"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name in kept]
    scored = found.mapInArrow(run, ", ".join([*fields, "n_best bigint, count_sum bigint, rest array<bigint>, rest_times array<int>"]))
    if not more:
        return scored.drop("row", "rest", "rest_times")
    scored = stash(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    sums = rare.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum")
    )
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return scored.join(sums, "row", "left").select(*[c for c in kept if c != "row"], plus("n_best", "_best"), plus("count_sum", "_sum"))
