"""Language identification of documents that may mix languages.

Training counts character trigrams (letters only, lower-cased, exact) per language over all documents with a
label: each task adds up its own texts, what it has is shuffled and summed.  A language gives a trigram its
share of the counts; as much of the mass as it has distinct trigrams per trigram seen (Witten-Bell) goes to
trigrams of equally likely characters, so unseen ones keep a chance.  A document
is a bag of trigrams drawn from a mixture of languages.  Expectation-maximisation finds the
proportions; languages are then taken away, least first, as long as the log-likelihood loses less
than ``PENALTY`` per language times the logarithm of the length.  The largest proportion names the
document, and the others are its further languages.

The counts grow with the corpus.  Up to ``CELLS`` numbers (trigrams times languages) the model is
broadcast and inference needs no shuffle; a larger one stays a table, and the trigrams of each distinct text
are joined with it.  Both ways give the same results.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no
document carries a label; equal proportions go to the alphabetically first language; columns named
like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from .common import extend, pieces, release, ship, stash, without

ship(__name__)

CELLS = 1 << 23  # 64 MB of likelihoods
HELD = 1 << 20  # trigrams that a task adds up before it passes them on
CODE_BITS = 21  # bits of a code point
ROUNDS = 12
PENALTY = 2.0
LETTERS = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def grams(text: str) -> np.ndarray:
    """The character trigrams of a text reduced to words between single spaces, 21 bits a character."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4").astype(np.int64)
    return (c[:-2] << 2 * CODE_BITS) | (c[1:-1] << CODE_BITS) | c[2:]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text in ascending order, and their counts."""
    return np.unique(grams(text or ""), return_counts=True)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of their numbers."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n[order], first)


def counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, n`` summed over all rows with a text and a language."""

    def run(batches):
        release()
        held: dict[str, list] = {}
        waiting = 0

        def flush():
            for name, some in held.items():
                key, n = summed(np.concatenate([k for k, _ in some]), np.concatenate([n for _, n in some]))
                yield name, key, n

        def batch_of(name, key, n):
            return pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for piece in pieces(batch):
                for t, name in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    key, n = bag(t)
                    held.setdefault(name, []).append((key, n))
                    waiting += len(key)
                    if waiting > HELD:
                        done = list(flush())
                        waiting = sum(len(key) for _, key, _ in done)
                        if waiting > HELD // 2:
                            yield from (batch_of(*x) for x in done)
                            held, waiting = {}, 0
                        else:
                            held = {name: [(key, n)] for name, key, n in done}
        yield from (batch_of(*x) for x in flush())

    known = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return known.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def likelihoods(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, chance: float) -> np.ndarray:
    """Likelihoods from counts (trigrams, languages), the trigrams seen and the distinct ones per language."""
    return (n + kinds * chance) / np.maximum(total + kinds, 1)


class Mixture:
    """Inference for one document from the likelihoods of its trigrams."""

    def __init__(self, langs: list[str], chance: float, penalty: float = PENALTY, rounds: int = ROUNDS):
        self.langs, self.chance, self.penalty, self.rounds = langs, chance, penalty, rounds

    def fit(self, like: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions after expectation-maximisation, and their log-likelihood."""
        total = n.sum()
        for _ in range(self.rounds):
            mix = share @ like
            new = share * (like @ (n / mix)) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(share @ like))

    def infer(self, like: np.ndarray, n: np.ndarray) -> tuple[str, float, list[str], list[float], float | None]:
        """Language, proportion, all languages and proportions, and the log-likelihood per trigram above that of equally likely characters.

        ``like`` is (languages, trigrams), ``n`` counts the trigrams.
        """
        if not len(n) or not self.langs:
            return "und", 0.0, [], [], None
        live = np.arange(len(self.langs))
        share, best = self.fit(like, n, np.full(len(live), 1 / len(live)))
        cost = self.penalty * np.log(n.sum() + 1)
        while len(live) > 1:
            rest = np.arange(len(live)) != share.argmin()
            start = share[rest] + 1e-6
            fewer, value = self.fit(like[live[rest]], n, start / start.sum())
            if best - value > cost:
                break
            live, share, best = live[rest], fewer, value
        order = np.lexsort((live, -share))
        names, parts = [self.langs[live[i]] for i in order], [min(1.0, float(share[i])) for i in order]
        return names[0], parts[0], names, parts, best / float(n.sum()) - float(np.log(self.chance))


class Table:
    """A model small enough to be held: sorted trigrams and their likelihoods; the last row is for unseen ones."""

    def __init__(self, mixture: Mixture, key: np.ndarray, like: np.ndarray):
        self.mixture, self.key, self.like = mixture, key, like

    def infer(self, text: str | None):
        if not text or not self.mixture.langs or not LETTERS.search(text):
            return self.mixture.infer(self.like[:0].T, np.zeros(0, np.int64))
        g, n = bag(text)
        at = np.searchsorted(self.key, g)
        at[at == len(self.key)] = 0
        at[self.key[at] != g] = len(self.key)
        return self.mixture.infer(np.ascontiguousarray(self.like[at].T), n)


@dataclass
class Model:
    """Counts ``lang, gram, n`` of a corpus with the sums of each language, and the table, if it is small enough."""

    langs: list[str]
    total: np.ndarray
    kinds: np.ndarray
    chance: float
    counts: DataFrame | None
    table: Table | None

    @property
    def mixture(self) -> Mixture:
        return Mixture(self.langs, self.chance)


def train(df: DataFrame, text: str = "text", lang: str = "lang", cells: int = CELLS) -> Model:
    """The model of all labelled rows.  Sums per language reach the driver, and counts only if they fit ``cells``."""
    found = stash(counts(df, text, lang), "trigrams")
    sums = sorted(found.groupBy("lang").agg(F.sum("n"), F.count("*")).collect())
    langs = [r[0] for r in sums]
    total, kinds = (np.array([r[i] for r in sums], np.float64) for i in (1, 2))
    some = F.array(*[F.shiftright("gram", i * CODE_BITS).bitwiseAND((1 << CODE_BITS) - 1) for i in range(3)])
    size = found.agg(F.count_distinct("gram")).first()[0]
    letters = found.select(F.explode(some).alias("c")).agg(F.count_distinct("c")).first()[0]
    chance = float(letters + 1) ** -3  # one more character stands for all unseen ones
    model = Model(langs, total, kinds, chance, found, None)
    if (size + 1) * max(1, len(langs)) <= cells:
        rows = found.toArrow()
        key, at = np.unique(rows.column("gram").to_numpy(), return_inverse=True)
        place = {name: i for i, name in enumerate(langs)}
        n = np.zeros((len(key) + 1, len(langs)))
        n[at, [place[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
        model.table = Table(model.mixture, key, likelihoods(n, total, kinds, chance))
    return model


KINDS = [("lang_pred", "string"), ("score", "double"), ("langs", "array<string>"), ("proportions", "array<double>"), ("fit", "double")]
ARROW = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64())


def identify(df: DataFrame, model: Model, text: str = "text", fit: str | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (its proportion), ``langs`` and ``proportions`` (all that remain, largest first).

    ``fit`` names a further column: how much better than by chance the languages explain a trigram, null without letters.
    """
    fields = [*KINDS[:4], *([(fit, "double")] if fit else [])]
    if model.table is None:
        return _joined(df, model, text, fields)
    shared = df.sparkSession.sparkContext.broadcast(model.table)

    def make():
        release()
        tool = shared.value

        def fn(batch):
            found = [tool.infer(t) for t in batch.column(text).to_pylist()]
            return [pa.array([x[i] for x in found], kind) for i, kind in enumerate(ARROW[: len(fields)])]

        return fn

    return extend(df, fields, make)


def _joined(df: DataFrame, model: Model, text: str, fields: list[tuple[str, str]]) -> DataFrame:
    """``identify`` with the model left as a table: the trigrams of distinct texts meet its rows, texts are told apart by two hashes."""
    hashes = [F.xxhash64(F.lit(i), F.col(text)).alias(f"h{i}") for i in (1, 2)]
    tool, langs, total, kinds, chance = model.mixture, model.langs, model.total, model.kinds, model.chance

    def bags(batches):
        for batch in batches:
            for piece in pieces(batch):
                for h1, h2, t in zip(*[c.to_pylist() for c in piece.columns]):
                    g, n = bag(t)
                    one = [pa.array(np.full(len(g), h, np.int64)) for h in (h1, h2)]
                    yield pa.RecordBatch.from_arrays([*one, pa.array(g), pa.array(n.astype(np.int64))], names=["h1", "h2", "gram", "n"])

    def infer(batches):
        for batch in batches:
            for row in (row for piece in pieces(batch) for row in piece.to_pylist()):
                got = sorted((x["gram"], x["n"], x["seen"] or []) for x in row["bag"])
                seen = np.zeros((len(got), len(langs)))
                for i, (_, _, counted) in enumerate(got):
                    for x in counted:
                        seen[i, langs.index(x["lang"])] = x["m"]
                like = np.ascontiguousarray(likelihoods(seen, total, kinds, chance).T)
                out = tool.infer(like, np.array([x[1] for x in got], np.int64))
                values = [row["h1"], row["h2"], *out[: len(fields)]]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.int64(), *ARROW))], names=["h1", "h2", *names])

    names = [n for n, _ in fields]
    texts = df.select(*hashes, F.col(text).alias("text")).where("text IS NOT NULL").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    rows = model.counts.groupBy("gram").agg(F.collect_list(F.struct("lang", F.col("n").alias("m"))).alias("seen"))
    met = salted_join(texts.mapInArrow(bags, "h1 bigint, h2 bigint, gram bigint, n bigint"), rows, ["gram"], ["h1"], how="left")
    whole = met.groupBy("h1", "h2").agg(F.collect_list(F.struct("gram", "n", "seen")).alias("bag"))
    found = whole.mapInArrow(infer, ", ".join(["h1 bigint", "h2 bigint", *[f"`{n}` {t}" for n, t in fields]]))
    # The row travels as one struct, so its column names cannot clash with ours.
    kept = without(df, names).columns
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *hashes)
    spread = F.monotonically_increasing_id().alias("_at")
    back = salted_join(own.select("*", spread), found.select("h1", "h2", F.struct(*[F.col(f"`{n}`") for n in names]).alias("found")), ["h1", "h2"], ["_at"], how="left")
    other = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "langs": F.array().cast("array<string>"), "proportions": F.array().cast("array<double>")}
    value = lambda n: F.col("found").getField(n)
    return back.select(*[F.col("row").getField(c).alias(c) for c in kept], *[(F.coalesce(value(n), other[n]) if n in other else value(n)).alias(n) for n in names])


def accepted(fit: str = "fit"):
    """Documents with letters whose languages together explain them at least as well as chance."""
    return F.coalesce(F.col(fit) >= 0, F.lit(False))
