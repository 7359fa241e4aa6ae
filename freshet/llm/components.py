"""Groups of linked items without listing the pairs of a group.

Items share bucket keys; a pair counts as a link when it shares a key and passes a check.  Only the
components matter here, so a bucket never emits all its pairs:

1. every member is checked against the smallest and the largest member of its bucket, and the
   verified links are joined to components; in a bucket of up to three this checks every pair;
2. in each larger bucket that still holds several components, members outside the most frequent one are
   checked against all members of other components.  This finds every link that joins two
   components, so nothing is lost, and a bucket full of one group's copies costs nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lineage
from ..functions.skew import salted_join
from .common import stash, tidy

CHECKED = 3  # members whose pairs all hold the smallest or the largest of them


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder; what was shuffled for it goes."""
    with tidy(df.sparkSession):
        return lineage.cut(df)


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every end of an edge ``a, b``: comp is the smallest node that can be reached.

    Union-find by stars: each round hangs the larger neighbours of a node on its smallest one, then
    the smaller ones too; the depth shrinks geometrically and the result is a forest of stars.
    Every round is a reliable checkpoint.  Self-loops, repeated edges and an empty table are fine.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == state or not sign[0]:
            break
        state = sign
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def joined_pairs(mixed: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a, b`` across components, by an equality join on the bucket key and a check of each pair.

    Fits keys so selective that members of different components rarely share one.
    """
    rest = mixed.where("comp <> main").select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), "main")
    other = mixed.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"))
    # Two members outside the main component meet once, in the order of their components.
    pairs = rest.join(other, "key").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("ca") < F.col("cb"))))
    return verify(pairs.select("a", "b"))


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], name: str, across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node, comp`` of the nodes with a link; ``members`` is ``key, node``.

    ``verify`` gets candidate pairs ``a, b`` (some repeated) and returns those that are links.
    ``across`` gets ``key, node, comp, main, size, rest`` of the buckets that hold several components and more than ``CHECKED`` members
    (their members, and those outside the main component), and returns links ``a, b`` between components, enough of them to connect all that a link connects.
    """
    # Ends and members leave the same sorted shuffle; a bucket's rows are spilled, not held.
    w = Window.partitionBy("key")
    crowd = members.select("key", "node", F.min("node").over(w).alias("lo"), F.max("node").over(w).alias("hi")).where("lo < hi").distinct()
    crowd = stash(crowd, f"{name}-buckets")
    stars = crowd.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
    first = cut(components(verify(stars)))
    placed = crowd.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    placed = stash(placed, f"{name}-placed")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("rest"))
    main = main.where(f"kinds > 1 AND size > {CHECKED}").drop("kinds")
    mixed = placed.join(main, "key")
    more = across(mixed) if across else joined_pairs(mixed, verify)
    named = more.join(first.select(F.col("node").alias("a"), F.col("comp").alias("_ca")), "a", "left")
    named = named.join(first.select(F.col("node").alias("b"), F.col("comp").alias("_cb")), "b", "left")
    second = cut(components(named.select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b"))))
    up = second.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = salted_join(first, up, ["comp"], ["node"], how="left").select("node", F.coalesce("top", "comp").alias("comp"))
    return old.union(second.join(first.select("node"), "node", "left_anti"))
