"""Change points after the tenth, and stability over all its rounds."""

from pyspark.sql import functions as F

from freshet.operators import trend as TR
from freshet.plans import load, series_queries

SF = "/root/testdata/sf0.01"


def test_all_change_points(spark, monkeypatch):
    days = spark.range(600).select(F.lit("a").alias("series_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                   (F.floor(F.col("id") / 30) % 7 * 10 + F.col("id") % 3).cast("double").alias("value"))
    monkeypatch.setattr(series_queries, "tr_daily", lambda spark, sf: days)
    points = load()["cpt_binary_segmentation"].build(spark, SF).count()
    assert points > 10 and points == TR.binary_segmentation(days).count()
    assert load()["cpt_segments"].build(spark, SF).count() == points + 1


def test_stability_has_20_rounds(spark):
    rows = load()["clu_stability"].build(spark, SF).collect()
    assert sorted(r["round"] for r in rows) == list(range(20)) and all(r["ari"] <= 1 for r in rows)
