"""What the joining of links leaves behind and checks twice."""

import time

from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.components import linked


def test_small_buckets_are_checked_once(spark):
    """All pairs of up to three members hold the smallest or the largest; repeated members count once."""
    rows = [(1, 10), (1, 11), (2, 20), (2, 21), (2, 22), (2, 22), (2, 20), (3, 30), (3, 31), (3, 32), (3, 33)]
    members = spark.createDataFrame(rows, "key bigint, node bigint")
    dealt = []

    def verify(pairs):
        return pairs.where((F.col("a") + F.col("b")).isin(21 + 22, 10 + 11))

    def across(mixed):
        dealt.extend(mixed.collect())
        return spark.createDataFrame([(31, 32)], "a bigint, b bigint")

    got = linked(members, verify, "small", across)
    assert {tuple(x) for x in got.collect()} == {(10, 10), (11, 10), (21, 21), (22, 21), (31, 31), (32, 31)}
    assert {(x.key, x.node) for x in dealt} == {(3, 30), (3, 31), (3, 32), (3, 33)} and len(dealt) == 4


def test_stash_leaves_no_shuffle_files(spark):
    files = lambda: {f.toString() for f in _all(spark) if f.getName().startswith("shuffle_")}
    before, set_before = files(), spark.conf.get(common.TIDY, None)
    out = common.stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "tidy")
    assert sorted(x.n for x in out.collect()) == [142] + [143] * 6
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert spark.conf.get(common.TIDY, None) == set_before


def _all(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]
