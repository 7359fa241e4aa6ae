"""URL filter: list rules first, then the ratio of two character models.

URLs that a rule decides are the training text: one model for accepted and one for rejected URLs.
Both are Markov models of variable order with Witten-Bell smoothing: a character's probability mixes
the counts after the longest seen context with those after ever shorter ones.  The score of a
URL is the difference of its log-likelihoods per character.  One fifth of the URLs with a rule, by hash,
is kept out of the counts and calibrates the threshold: the cut with the best balanced accuracy.

Everything is DataFrame code.  Counts are combined before they are shuffled; characters meet their
scores in a salted join, since every URL holds the grams of its scheme; the driver sees one number,
the threshold.

Defined cases: a null URL, or one without ``://``, has an empty host and path; a URL without
characters scores 0 and is allowed; characters outside printable ASCII count as one symbol; without
accepted or rejected training URLs all scores are 0 and the threshold is 0; repeated rows are judged
alike; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from .common import ascii_lower, stash, without

ORDER = 4
SYMBOLS = 96  # 94 printable characters, the start mark, and one for all others
HELD_OUT = 5
BIN = 0.01
START = "\u0002"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return without(df, ["host", "path"]).withColumns({
        "host": ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    })


def rule_columns(rules: Sequence[tuple[str, str]]):
    """The longest rule that fits ``host`` and ``path``, and its verdict; ``rules`` is (verdict, ``host/path``)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        host, slash, path = text.partition("/")
        host = host.lower()
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, order: int = ORDER, keep: Sequence[str] = ()) -> DataFrame:
    """One row per character: ``gram`` is the character after its ``order`` predecessors."""
    known = F.regexp_replace("url", r"[^\x21-\x7E]", "\u007f")
    padded = F.split(F.concat(F.lit(START * order), known), "")
    return (
        urls.select(*keep, padded.alias("c"))
        .select(*keep, "c", F.explode(F.sequence(F.lit(1), F.size("c") - order)).alias("i"))
        .select(*keep, F.array_join(F.slice("c", F.col("i"), order + 1), "").alias("gram"))
    )


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio``: log of accepted over rejected probability of each gram's last character.

    ``counts`` is ``gram, acc, rej``, one row per gram of full length.
    """
    levels = counts.select("acc", "rej", F.posexplode(F.array(*[F.expr(f"right(gram, {k + 1})") for k in range(order + 1)])).alias("k", "s"))
    levels = levels.groupBy("k", "s").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    levels = levels.withColumn("h", F.expr("left(s, k)"))
    sums = [f(F.col(c)).alias(n) for c in ("acc", "rej") for f, n in ((F.sum, f"n_{c}"), (lambda x: F.count_if(x > 0), f"t_{c}"))]
    contexts = levels.groupBy("k", "h").agg(*sums)
    both = levels.join(contexts, ["k", "h"])
    # A context that a model never saw leaves the whole weight to the shorter one.
    parts = []
    for c in ("acc", "rej"):
        size = F.col(f"n_{c}") + F.col(f"t_{c}")
        parts += [F.when(size > 0, F.col(c) / size).otherwise(0.0).alias(f"p_{c}"), F.when(size > 0, F.col(f"t_{c}") / size).otherwise(1.0).alias(f"w_{c}")]
    table = both.select("k", "s", *parts)
    wanted = counts.select("gram", F.posexplode(F.array(*[F.expr(f"right(gram, {k + 1})") for k in range(order + 1)])).alias("k", "s"))
    met = salted_join(wanted, table, ["k", "s"], ["gram"])
    cells = [F.max(F.when(F.col("k") == k, F.col(f"{x}_{c}"))).alias(f"{x}_{c}{k}") for c in ("acc", "rej") for k in range(order + 1) for x in "pw"]
    wide = met.groupBy("gram").agg(*cells)

    def chance(c):
        p = F.lit(1.0 / SYMBOLS)
        for k in range(order + 1):
            p = F.col(f"p_{c}{k}") + F.col(f"w_{c}{k}") * p
        return p

    return wide.select("gram", (F.log(chance("acc")) - F.log(chance("rej"))).alias("ratio"))


def scores(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``url, n, said, held_out, score`` per distinct url; ``labelled`` is ``url, said`` with said null where no rule fits."""
    urls = labelled.where("url <> ''").groupBy("url").agg(F.count("*").alias("n"), F.first("said").alias("said"))
    urls = stash(urls.withColumn("held_out", F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0), "urls")
    weight = lambda verdict: F.when((F.col("said") == verdict) & ~F.col("held_out"), F.col("n")).otherwise(0)
    seen = grams(urls.select("url", weight("allow").alias("acc"), weight("block").alias("rej")), order, ["acc", "rej"])
    counts = stash(seen.groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")), "grams")
    table = stash(log_ratios(counts, order), "ratios")
    by_url = salted_join(grams(urls, order, ["url"]), table, ["gram"], ["url"]).groupBy("url").agg(F.avg("ratio").alias("score"))
    # Models trained on one side only say nothing.
    both = counts.agg(F.least(F.sum("acc"), F.sum("rej")).alias("least")).first()["least"]
    score = F.col("score") if both else F.lit(0.0)
    return stash(urls.join(by_url.select("url", score.alias("score")), "url"), "url-scores")


def threshold(scored: DataFrame) -> float:
    """The cut with the best balanced accuracy on the held-out URLs that a rule decides (the one nearest zero among equals)."""
    bins = scored.where("held_out AND said IS NOT NULL").groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.sum(F.when(F.col("said") == "allow", F.col("n")).otherwise(0)).alias("acc"),
        F.sum(F.when(F.col("said") == "block", F.col("n")).otherwise(0)).alias("rej"),
    )
    # One row per bin: log-ratios per character lie within a few units, so there are some thousand bins at most.
    up, whole = Window.orderBy("bin"), Window.partitionBy()
    cuts = bins.select(
        (F.col("bin") * BIN).alias("cut"), (F.sum("acc").over(whole) - F.sum("acc").over(up) + F.col("acc")).alias("kept"), F.sum("acc").over(whole).alias("all_acc"),
        (F.sum("rej").over(up) - F.col("rej")).alias("gone"), F.sum("rej").over(whole).alias("all_rej"),
    ).where("all_acc > 0 AND all_rej > 0")
    best = cuts.orderBy((F.col("kept") / F.col("all_acc") + F.col("gone") / F.col("all_rej")).desc(), F.abs("cut"), "cut").first()
    return float(best["cut"]) if best else 0.0


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", order: int = ORDER) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` (allow or block) and ``score`` to every row."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(url).alias("url"))
    rule, said = rule_columns(rules)
    ruled = parts(own).withColumns({"rule": rule, "said": said})
    scored = scores(ruled.select("url", "said"), order)
    cut = threshold(scored)
    joined = ruled.withColumn("_at", F.xxhash64("row"))
    joined = salted_join(joined, scored.select("url", "score"), ["url"], ["_at"], how="left")
    score = F.coalesce("score", F.lit(0.0))
    empty = F.coalesce(F.col("url"), F.lit("")) == ""
    verdict = F.coalesce("said", F.when(empty | (score >= cut), "allow").otherwise("block"))
    outs = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": verdict, "score": score}
    kept = [c for c in df.columns if c.lower() not in outs]
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], *[c.alias(n) for n, c in outs.items()])
