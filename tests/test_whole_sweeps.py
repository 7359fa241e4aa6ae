"""Registered clusterings do the operators' whole jobs."""

from freshet.operators import clustering as CL
from freshet.plans import load

SF = "/root/testdata/sf0.01"


def fitted(monkeypatch):
    """The numbers of clusters that k-means is asked for."""
    asked, own = [], CL.KMeans
    monkeypatch.setattr(CL, "KMeans", lambda **kw: asked.append(kw["k"]) or own(**kw))
    return asked


def test_silhouette_sweep_covers_2_to_20(spark):
    rows = load()["clu_silhouette_sweep"].build(spark, SF).collect()
    assert sorted(r["k"] for r in rows) == list(range(2, 21))
    assert all(-1 <= r["min_silhouette"] <= r["mean_silhouette"] <= 1 for r in rows)


def test_granularity_sweep_has_six_sizes(spark, monkeypatch):
    asked = fitted(monkeypatch)
    rows = load()["clu_granularity_sweep"].build(spark, SF).collect()
    # 25, 30, 40, 50, 60 and 80 of 2,746 sites, for 500 vectors
    assert sorted(r["min_size"] for r in rows) == [5, 6, 8, 10, 11, 15]
    assert asked == [60] * 6


def test_end_members_have_60_micro_clusters(spark, monkeypatch):
    asked = fitted(monkeypatch)
    rows = load()["clu_end_members"].build(spark, SF).collect()
    assert asked == [60] and sum(r["n"] for r in rows) == 500
