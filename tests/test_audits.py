"""Aggregation rules, combined features and column audits on known answers."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import attributes as AT
from freshet.operators import grid as GR
from freshet.operators import validation as VA


def test_aggregation_by_rule(spark):
    rows = [("a", 1.0, 10.0, 2.0), ("a", 2.0, None, 4.0), ("b", None, 5.0, None)]
    df = spark.createDataFrame(rows, "k string, prcp double, t double, runoff double")
    got = {r.k: r[1:] for r in GR.aggregate_by_rule(df, ["prcp", "t", "runoff"], ["k"], totals=["runoff"]).collect()}
    assert got == {"a": (3.0, 10.0, 6.0), "b": (None, 5.0, None)}
    assert GR.aggregate_by_rule(df.limit(0), ["prcp"], ["k"]).count() == 0


@pytest.mark.parametrize("always", [("x", "gone"), ("gone",)])
def test_combined_features(spark, always):
    screened = spark.createDataFrame([("x", True), ("y", False), ("z", True)], "feature string, keep boolean")
    got = {(r.feature, r.fixed, r.selected) for r in AT.combined_feature_table(screened, ["x", "y", "z"], always).collect()}
    assert got == {("x", "x" in always, True), ("z", False, True)}
    assert sorted(f for f, *_ in got) == AT.combined_features(["x", "z"], ["x", "y", "z"], always)


def test_column_audit(spark):
    df = spark.createDataFrame([(1, None), (2, "u")], "`a.b` int, note string")
    df = df.select(F.col("`a.b`").alias("a.b", metadata={"units": "1", "long_name": "n", "source": "s"}), "note")
    got = {r["column"]: (r["missing"], r.n_rows, r.n_null, r.ok) for r in VA.column_audit(df).collect()}
    assert got == {"a.b": ("", 2, 0, True), "note": ("units,long_name,source", 2, 1, False)}
    assert [r.n_rows for r in VA.column_audit(df.limit(0)).collect()] == [0, 0]
