"""Rules: parsed paths, held-out accuracy, and defined cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from freshet.llm import rule_ensemble as R
from freshet.llm.queries import QUERIES, table


def test_rules_find_a_planted_conjunction():
    r = np.random.default_rng(1)
    x = r.random((4000, 6))
    y = ((x[:, 1] > 0.3) & (x[:, 4] <= 0.6)).astype(float)
    rules = R.fit(x, y, list("abcdef"))
    z = rules.start + sum(w * np.all([x[:, j] <= c if s == "<=" else x[:, j] > c for j, s, c in rule], axis=0) for rule, w in rules.weighted)
    assert ((z >= 0) == y).mean() > 0.97
    assert len(rules.weighted) < 150 and all(len(rule) <= R.DEPTH for rule, _ in rules.weighted)


def test_held_out_accuracy(spark, sf):
    got = QUERIES["op8_rule_ensemble"](spark, sf)
    docs = table(spark, sf, "documents")
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    right, n = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.9


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "fine words here.", 0), (3, "fine words here.", 0), (None, "x " * 50_000, 0)], "doc_id bigint, text string, Predicted int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = R.judge(df, none)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    assert [(x.score, x.predicted) for x in got.collect()] == [(0.5, 1)] * 5
    one = R.judge(df, spark.createDataFrame([(1, 0), (3, 0), (9, 1), (2, None)], "doc_id bigint, quality int")).collect()
    assert all(x.score < 1e-9 and x.predicted == 0 for x in one)
    assert R.judge(df.limit(0), none).count() == 0
    row = R.statistics(df.where("doc_id = 3"), "text")[0].select("s.*").first()
    assert row.chars == math.log1p(16) and row.words == math.log1p(3) and row.distinct_words == 1 and row.echoes == 0 and row.capitals == 0
