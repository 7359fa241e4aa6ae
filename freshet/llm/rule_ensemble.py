"""Document quality by a sparse ensemble of rules.

Every text is reduced to a few statistics by column expressions.  Shallow randomised trees are grown
on labelled rows; each path from a root is a rule (a conjunction of thresholds).  A logistic
regression with an L1 penalty weighs the rules and leaves most of them at zero; those that remain
are compiled into one Spark column expression, so scoring is a projection without Python.

Statistics are written once and serve both training and scoring.  Trees and weights are fitted on the
driver, on at most ``SAMPLE`` labelled rows, those with the smallest hashes of key and statistics.

Defined cases: null and empty texts have all statistics zero and are scored like any other; if
only one class is labelled, every score is its label, and 0.5 if there is no label; a document with
several labels counts once for each; columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

TREES, DEPTH, PENALTY, SEED = 20, 3, 0.002, 11
SAMPLE = 50_000  # labelled rows that trees and weights are fitted on
BINS, LEAST, STEPS = 32, 20, 300


def statistics(df: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """Add ``s``, a struct of numbers that describe a text, and return their names.

    Words and lines are columns of a projection of their own, so that they are split once per text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cut = df.select("*", t.alias("_t"), F.filter(F.split(t, r"\s+"), lambda w: w != "").alias("_words"), F.filter(F.split(t, "\n"), lambda s: F.trim(s) != "").alias("_lines"))
    t, words, lines = F.col("_t"), F.col("_words"), F.col("_lines")
    n, chars = F.size(words), F.length(t)
    left = lambda outside: F.length(F.regexp_replace(t, outside, ""))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    same = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: a == b)
    sizes = cut.select("*", left(r"[^\p{L}]+").alias("_letters"))
    letters = F.col("_letters")
    stats = {
        "chars": F.log1p(chars), "words": F.log1p(n), "lines": F.log1p(F.size(lines)),
        "word_length": share(chars, n), "line_length": share(chars, F.size(lines)),
        "letters": share(letters, chars), "capitals": share(left(r"[^\p{Lu}]+"), letters), "digits": share(left("[^0-9]+"), chars),
        "symbols": share(left(r"[^#$%&*@^~|<>+=_\\]+"), n), "calls": share(left("[^!?]+"), n), "stops": share(left("[^.,;:]+"), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n), "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "echoes": share(F.size(F.filter(same, lambda x: F.coalesce(x, F.lit(False)))), n),
    }
    out = sizes.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(*[v.cast("double").alias(k) for k, v in stats.items()]).alias("s"))
    return out, list(stats)


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> set[tuple]:
    """Paths of one tree, each a tuple of conditions (statistic, ``<=`` or ``>``, threshold).

    The tree sees a bootstrap sample, and a third of the statistics at each node; splits are the best by Gini
    impurity among quantiles.
    """
    weight = rng.poisson(1.0, len(y)).astype(float)
    found: set[tuple] = set()

    def split(rows: np.ndarray, path: tuple) -> None:
        n, ones = weight[rows].sum(), (weight[rows] * y[rows]).sum()
        if len(path) == depth or n < 2 * LEAST or ones in (0, n):
            return
        best = (1e-9, None, None)
        for j in rng.choice(x.shape[1], max(1, round(x.shape[1] / 3)), replace=False):
            v = x[rows, j]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            side = np.searchsorted(cuts, v)
            a = np.cumsum(np.bincount(side, weight[rows], len(cuts) + 1))[:-1]
            b = np.cumsum(np.bincount(side, weight[rows] * y[rows], len(cuts) + 1))[:-1]
            with np.errstate(all="ignore"):
                gain = (b * b / a + (ones - b) ** 2 / (n - a)) - ones * ones / n
            gain[~((a >= LEAST) & (n - a >= LEAST))] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), int(j), float(cuts[gain.argmax()]))
        _, j, cut = best
        if j is None:
            return
        low = x[rows, j] <= cut
        for side, part in (("<=", rows[low]), (">", rows[~low])):
            found.add((*path, (j, side, cut)))
            split(part, (*path, (j, side, cut)))

    split(np.arange(len(y)), ())
    return found


def lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression on scaled columns, by accelerated proximal steps."""
    scale = r.std(0)
    scale[scale == 0] = np.inf
    z = ((r - r.mean(0)) / scale).astype(np.float32)
    v = np.random.default_rng(0).normal(size=z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (0.25 * (np.linalg.norm(z @ v) ** 2 / len(y) + 1.0) * 1.05)
    w = old = np.zeros(z.shape[1])
    b = old_b = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / nt
        u, c = w + m * (w - old), b + m * (b - old_b)
        g = 1 / (1 + np.exp(-(z @ u + c))) - y
        old, old_b, t = w, b, nt
        w = u - step * (z.T @ g) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = c - step * float(g.mean())
    w = w / scale
    return w, b - float(r.mean(0) @ w)


def holds(rule, names: list[str]) -> Column:
    """A rule as a column."""
    test = F.lit(True)
    for i, sign, value in rule:
        c = F.col(f"s.{names[i]}")
        test = test & (c <= value if sign == "<=" else c > value)
    return test


class Rules:
    """Weighted rules over named statistics."""

    def __init__(self, names: list[str], weighted: list[tuple[tuple, float]], start: float):
        self.names, self.weighted, self.start = names, weighted, start

    def score(self) -> Column:
        z = F.lit(self.start)
        for rule, weight in self.weighted:
            z = z + F.when(holds(rule, self.names), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Rules from statistics (n, names) and labels 0 or 1."""
    if not len(y) or y.min() == y.max():
        return Rules(names, [], 0.0 if not len(y) else 30.0 if y[0] else -30.0)
    rng = np.random.default_rng(SEED)
    rules = sorted(set().union(*(grow(x, y, depth, rng) for _ in range(trees))))
    if not rules:
        return Rules(names, [], float(np.log(y.mean() / (1 - y.mean()))))
    tests = np.stack([np.all([x[:, j] <= c if sign == "<=" else x[:, j] > c for j, sign, c in rule], axis=0) for rule in rules], 1)
    weights, start = lasso(tests.astype(np.float32), y, penalty)
    return Rules(names, [(r, float(w)) for r, w in zip(rules, weights) if w], start)


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to every row; ``labels`` is ``key, label`` of the rows to learn from."""
    kept = [c for c in df.columns if c.lower() not in ("score", "predicted")]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("text"))
    described, stats = statistics(own, "text")
    rows = stash(described.select("row", "s"), "statistics")
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    labelled = rows.select(F.col("row").getField(key).alias("_key"), "s").join(known, "_key")
    sample = labelled.orderBy(F.xxhash64("_key", "s", "label")).limit(SAMPLE).select("label", *[F.col(f"s.{n}").alias(n) for n in stats]).toArrow()
    x = np.stack([sample.column(n).to_numpy() for n in stats], 1) if sample.num_rows else np.zeros((0, len(stats)))
    rules = fit(x, sample.column("label").to_numpy().astype(float), stats)
    score = rules.score()
    return rows.withColumn("_score", score).select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
