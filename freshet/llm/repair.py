"""Token ids in grammar-compressed shards (Re-Pair), written as Parquet and read back from it.

``write`` range-partitions documents by id, encodes them inside their partition, cuts the run of
ids into shards of bounded size and compresses each one: every round counts the pairs of
neighbouring symbols, replaces the most frequent ones by new symbols, and goes on until no pair occurs twice or, for
vocabularies that leave room for rules in 16 bits, that room is used up; wider symbols would double the sequence.  A shard row holds its documents, the rules (left and right symbol), the expansion length
of every rule and the final sequence.  Lengths give the position of any id without decoding what
lies before it (``ids_at``).  Spark's writer commits the files, so retried tasks leave no duplicates.

Defined cases: a null or empty text yields only the closing id; equal document ids are ordered by
the hash of their texts; an empty table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_worker, pieces, ship

ship(__name__)

SHARD_IDS = 1 << 20
LONG = 64  # bytes of a stretch that is not remembered
WORDS = 1000  # plain words that are encoded as one text
# A word of Latin letters with any marks behind it, between which the splitter always cuts, or else the whole stretch.
STRETCH = re.compile(r"^(?:([a-zß-öø-ÿA-ZÀ-ÖØ-Þ]+)([!-&(-/:;=-@\[-`{-~]*)|(.+))$", re.M)
MIN_COUNT = 2
LEAST_ROOM = 1 << 12  # rules that 16-bit symbols must leave room for
SLOTS = 20  # bits of the lookup table of one round
LAST = 1 << 9  # rules that are left for the last rounds
CUT = 16  # a round takes all pairs with at least this fraction of the top count
SHARDS = (
    "part int, shard int, n_ids bigint, width int, base bigint, doc_ids array<bigint>, doc_lengths array<int>, "
    "rules binary, rule_lengths binary, sequence binary"
)


class Encoder:
    """The library's ids of a text, remembered per stretch between spaces, which no token spans.

    They are kept in two generations of about ``limit`` stretches each; that only saves time.
    """

    def __init__(self, spec: bytes, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_str(spec.decode())
        said = json.loads(spec)
        splits = [p for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        # Cutting at spaces is exact where white space is dropped before the merges.
        self.apart = any(p["behavior"] == "Removed" and p["invert"] for p in splits) and not any(" " in t["content"] for t in said["added_tokens"])
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Plain words pass the normalizer and the splitter with nothing but their case changed, so the model alone encodes them.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab, suffix = self.tokenizer.get_vocab(), said["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens that close a word
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.limit, self.known, self.old = limit, {}, {}

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not self.apart:
            return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        # A-Z and a-z have the same ids; a marker of a special token must stay as it is.
        shown = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        cut = pc.split_pattern(pc.replace_substring(shown, "\n", " "), " ")
        coded = pc.dictionary_encode(cut.flatten())
        stretches = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        with uncollected():
            long = self.learn(stretches)
        run = pa.array(list(map(self.known.__getitem__, stretches)), pa.binary()).take(coded.indices)
        for s in long:
            del self.known[s]
        _, ends, data = run.buffers()
        at = np.frombuffer(ends, "<i4")[cut.offsets.to_numpy()].tolist()
        whole = data.to_pybytes() if data else b""
        return [whole[a:b] for a, b in zip(at, at[1:])]

    def learn(self, stretches: list[bytes]) -> set[bytes]:
        """Put all stretches into ``known``; gives the new ones that are too long to stay there."""
        known, old = self.known, self.old
        known[b""] = b""
        new = []
        for s in stretches:
            if s not in known:
                if s in old:
                    known[s] = old[s]
                else:
                    new.append(s)
        found = STRETCH.findall(b"\n".join(new).decode())
        ids = self.made({word.lower() for word, _, _ in found}, self.words) | self.made({marks or other for _, marks, other in found}, self.others)
        names = {name: name.encode() for name in ids}
        known.update((names[name], value) for name, value in ids.items())
        known.update((s, ids[word.lower()] + ids[marks or other]) for s, (word, marks, other) in zip(new, found))
        return {s for s in (*new, *names.values()) if len(s) >= LONG}

    def made(self, names: set[str], encode) -> dict[str, bytes]:
        """The ids of words or of other stretches, taken from those known where possible."""
        ids = {name: self.known.get(key, self.old.get(key)) for name in names for key in [name.encode()]}
        todo = [name for name, value in ids.items() if value is None]
        return ids | dict(zip(todo, encode(todo)))

    def words(self, words: list[str]) -> list[bytes]:
        """Plain words are encoded many in one text and parted behind the tokens that close them."""
        if not words:
            return []
        many = [" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
        flat = np.concatenate([np.array(e.ids, self.kind) for e in self.plain.encode_batch_fast(many, add_special_tokens=False)])
        stops = ((np.flatnonzero(self.ends[flat]) + 1) * self.width).tolist()
        if len(stops) != len(words) or stops[-1] != flat.nbytes:  # a vocabulary without such tokens, or without a letter
            return [self.packed(e.ids) for e in self.plain.encode_batch_fast(words, add_special_tokens=False)]
        run = flat.tobytes()
        return [run[a:b] for a, b in zip([0, *stops], stops)]

    def others(self, stretches: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]


@contextmanager
def uncollected():
    """Without the garbage collector, which walks through everything again and again where millions of tuples are made."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur ``least`` times or more, with their counts."""
    s = np.sort(key)
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    counts = np.diff(np.append(starts, len(s)))
    often = counts >= least
    return s[starts[often]], counts[often]


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), their expansion lengths, and the compressed sequence; symbols from ``base`` on are rules."""
    small = base <= (1 << 16) - LEAST_ROOM
    kind = np.uint32 if small else np.uint64
    half, room = (16, (1 << 16) - base) if small else (32, 1 << 31)
    mix = kind(0x9E3779B1) if small else kind(0x9E3779B97F4A7C15)
    seq = ids.astype(kind)
    rules, n_rules = [], 0
    lens = np.ones(base, np.int64)
    step = None
    while len(seq) > 1 and room > n_rules:
        key = (seq[:-1] << kind(half)) | seq[1:]
        # A slot counts at least as much as any pair in it, so rare slots hold no frequent pair.
        slot = (key * mix) >> kind(8 * key.itemsize - SLOTS)
        crowd = np.bincount(slot, minlength=1 << SLOTS)
        step = max(min_count, min(int(crowd.max()), step or 1 << 62) // CUT)
        at = np.flatnonzero((crowd >= step)[slot])
        pairs, counts = frequent(key[at], step)
        if not len(pairs):
            if step <= min_count:
                break
            continue
        left = room - n_rules
        # The last rules are chosen among more pairs than there is room for, as overlaps take some of them out.
        order = np.argsort(counts, kind="stable")[::-1][: left if left > LAST else 4 * left][::-1]
        pairs = pairs[order]
        # The most frequent pair of a slot wins; the others wait for the next round.
        table = np.full(1 << SLOTS, -1, np.int32)
        table[(pairs * mix) >> kind(8 * key.itemsize - SLOTS)] = np.arange(len(pairs), dtype=np.int32)
        which = table[slot[at]]
        good = which >= 0
        at, which = at[good], which[good]
        good = pairs[which] == key[at]
        at, which = at[good], which[good]
        # In a run of overlapping pairs every other one is taken, from the left.
        first = np.concatenate(([True], np.diff(at) != 1))
        even = (at - np.repeat(at[first], np.diff(np.append(np.flatnonzero(first), len(at))))) % 2 == 0
        at, which = at[even], which[even]
        used = np.bincount(which, minlength=len(pairs))
        kept = used >= min(min_count, used.max())
        if kept.sum() > left:
            kept[np.argsort(np.where(kept, used, 0), kind="stable")[:-left]] = False
        good = kept[which]
        at, which = at[good], which[good]
        name = np.cumsum(kept) - 1 + base + n_rules
        chosen = pairs[kept]
        two = np.stack([chosen >> kind(half), chosen & kind((1 << half) - 1)], 1).astype(np.int64)
        rules.append(two)
        lens = np.concatenate([lens, lens[two[:, 0]] + lens[two[:, 1]]])
        n_rules += len(chosen)
        seq[at] = name[which].astype(kind)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), lens[base:], seq


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that a sequence stands for: one level of rules at a time."""
    seq = seq.astype(np.int64)
    while len(seq) and (high := seq >= base).any():
        out = np.repeat(seq, 1 + high)
        at = np.flatnonzero(high) + np.arange(int(high.sum()))
        two = rules[seq[high] - base]
        out[at], out[at + 1] = two[:, 0], two[:, 1]
        seq = out
    return seq


class Shard:
    """One row of the shard table, decoded."""

    def __init__(self, row: dict):
        kind = f"<u{row['width']}"
        self.base = row["base"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
        self.rule_lengths = np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)
        self.sequence = np.frombuffer(row["sequence"], kind).astype(np.int64)

    def ids(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.base)

    def ids_at(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; only the symbols that cover them are expanded."""
        lens = np.ones(len(self.sequence), np.int64)
        high = self.sequence >= self.base
        lens[high] = self.rule_lengths[self.sequence[high] - self.base]
        ends = np.cumsum(lens)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left") + 1
        skip = start - (ends[a - 1] if a else 0)
        return expand(self.sequence[a:b], self.rules, self.base)[skip : skip + n]


def _shard_row(part: int, shard: int, docs: list, lengths: list[int], ids: np.ndarray, width: int, base: int, min_count: int) -> dict:
    rules, rule_lengths, seq = compress(ids, base, min_count)
    wide = 2 if base + len(rules) <= 1 << 16 else 4
    return {
        "part": part, "shard": shard, "n_ids": len(ids), "width": wide, "base": base, "doc_ids": docs, "doc_lengths": lengths,
        "rules": rules.astype("<u4").tobytes(), "rule_lengths": rule_lengths.astype("<u4").tobytes(), "sequence": seq.astype(f"<u{wide}").tobytes(),
    }


def write(df: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS, min_count: int = MIN_COUNT) -> None:
    """Encode a table of texts and write its shards to ``path`` in ascending order of document ids."""
    with open(tokenizer, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int32())), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("sequence", pa.binary()),
    ])

    def run(batches):
        enc = per_worker("repair", lambda: Encoder(spec.value), spec.value)
        base = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        end = np.asarray([end_id], enc.kind).tobytes()
        part = TaskContext.get().partitionId()
        docs, lengths, held, n, shard = [], [], [], 0, 0

        def flush():
            ids = np.frombuffer(b"".join(held), enc.kind)
            return pa.RecordBatch.from_pylist([_shard_row(part, shard, docs, lengths, ids, enc.width, base, min_count)], schema)

        for batch in batches:
            for piece in pieces(batch):
                for doc, packed in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1))):
                    size = len(packed) // enc.width + 1
                    if n and n + size > shard_ids:
                        yield flush()
                        docs, lengths, held, n, shard = [], [], [], 0, shard + 1
                    docs.append(doc)
                    lengths.append(size)
                    held += [packed, end]
                    n += size
        if n:
            yield flush()

    key = [F.col("doc_id"), F.xxhash64("text")]
    named = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = named.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_le``: each document's place and its ids as little-endian 32-bit integers."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    # One row per partition of the writer, then one window per partition over its shards.
    before = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = before.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("shard")
    starts = sizes.join(before, "part").select("part", "shard", (F.col("_before") + F.sum("n_ids").over(inside) - F.col("n_ids")).alias("first"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_le", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = Shard(row).ids().astype("<u4")
                ends = np.cumsum([0, *row["doc_lengths"]])
                whole = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + row["first"]), pa.array(np.diff(ends).astype("i8")), whole,
                ], schema=schema)

    return shards.join(starts, ["part", "shard"]).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_le binary")
