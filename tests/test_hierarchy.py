"""Ward linkage and density clusters against plain versions over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector

from freshet.operators import hierarchy as H


def points(n=240, seed=0):
    r = np.random.default_rng(seed)
    parts = [r.normal(size=(n // 4, 3)) * 0.15 + [0, 0, 0], r.normal(size=(n // 4, 3)) * 0.5 + [4, 0, 0], r.normal(size=(n // 4, 3)) * 0.2 + [0, 4, 1]]
    return np.concatenate([*parts, r.uniform(-3, 7, size=(n - 3 * (n // 4), 3))])


def frame(spark, x):
    df = spark.createDataFrame(pd.DataFrame({"series_id": [f"s{i}" for i in range(len(x))], "v": x.tolist()})).repartition(6)
    return df.select("series_id", array_to_vector("v").alias("features"))


def plain_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = x[groups[i]], x[groups[j]]
                d = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or d < best[0]:
                    best = d, i, j
        groups[best[2]] += groups.pop(best[1])
    return {frozenset(g) for g in groups}


def as_sets(labels, noise=None):
    out = {}
    for i, c in enumerate(labels):
        if c != noise:
            out.setdefault(c, set()).add(i)
    return {frozenset(s) for s in out.values()}


def plain_density(x, m):
    """Sets of points and memberships, by removing edges of the complete graph from long to short."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    tree = []
    i, j = np.triu_indices(n, 1)
    for e in np.argsort(w[i, j], kind="stable").tolist():
        a, b = find(int(i[e])), find(int(j[e]))
        if a != b:
            up[a] = b
            tree.append((w[i[e], j[e]], int(i[e]), int(j[e])))
            if len(tree) == n - 1:
                break

    def split(nodes, edges):
        """What is left when all longest edges go, with its edges."""
        longest = max(e[0] for e in edges)
        kept = [e for e in edges if e[0] < longest]
        near = {v: [] for v in nodes}
        for _, a, b in kept:
            near[a].append(b), near[b].append(a)
        sides, left = [], set(nodes)
        while left:
            side, todo = set(), [left.pop()]
            while todo:
                v = todo.pop()
                side.add(v)
                todo += [u for u in near[v] if u not in side]
            left -= side
            sides.append((side, [e for e in kept if e[1] in side]))
        return 1 / longest, sides

    def grow(nodes, edges, born):
        """``(stability, chosen sets)`` of a cluster that begins at density ``born``."""
        members, falls, stability, top = frozenset(nodes), {}, 0.0, 0.0
        while edges:
            at, sides = split(nodes, edges)
            top = at
            large = [s for s in sides if len(s[0]) >= m]
            if len(large) > 1:
                stability += (at - born) * len(nodes)
                inner = [grow(*s, at) for s in large]
                gain = sum(g for g, _ in inner)
                mine = [(members, {v: min(falls.get(v, top) / top, 1) for v in members})]
                return (stability, mine) if stability >= gain else (gain, [c for _, cs in inner for c in cs])
            for s in sides:
                if s not in large:
                    stability += (at - born) * len(s[0])
                    falls.update({v: at for v in s[0]})
            if not large:
                break
            nodes, edges = large[0]
        return stability, [(members, {v: min(falls.get(v, top) / top, 1) for v in members})]

    nodes, edges = set(range(n)), tree
    while edges:  # the whole is never a cluster itself
        at, sides = split(nodes, edges)
        large = [s for s in sides if len(s[0]) >= m]
        if len(large) > 1:
            return [c for s in large for c in grow(*s, at)[1]]
        if not large:
            return []
        nodes, edges = large[0]


def test_ward_equals_the_plain_method(spark):
    x = points(90)
    for k in (1, 4, 15):
        assert as_sets(H.ward_labels(H.Leaves.of(x), k)) == plain_ward(x, k)
    rows = {r["series_id"]: r for r in H.ward_regimes(frame(spark, x), 6).collect()}
    assert as_sets([rows[f"s{i}"]["cluster"] for i in range(90)]) == plain_ward(x, 6)
    sizes = pd.Series([r["regime"] for r in rows.values()]).value_counts()
    assert sorted(sizes.index) == [1, 2, 3, 4, 5, 6] and list(sizes.sort_index()) == sorted(sizes, reverse=True)


@pytest.mark.parametrize("n,m,seed", [(240, 8, 0), (240, 20, 1), (400, 5, 2), (2000, 40, 3)])
def test_density_clusters_equal_the_plain_tree(n, m, seed):
    x = points(n, seed)
    label, member = H.density_labels(H.Leaves.of(x), m)
    want = plain_density(x, m)
    assert len(want) > 1
    assert as_sets(label, -1) == {s for s, _ in want}
    for s, inside in want:
        assert all(member[v] == pytest.approx(inside[v]) for v in s)
    assert (member[label < 0] == 0).all()


def test_members_on_spark_and_condensed_leaves(spark):
    x = points(600, 5)
    df = frame(spark, x)
    exact = {r["series_id"]: r for r in H.density_members(df, 15).collect()}
    label, member = H.density_labels(H.Leaves.of(x), 15)
    assert as_sets([exact[f"s{i}"]["end_member"] for i in range(600)], -1) == as_sets(label, -1)
    assert [exact[f"s{i}"]["membership"] for i in range(600)] == pytest.approx(member.tolist())
    # Far fewer leaves than vectors: the large groups stay the same.
    few = H.summarise(df, 120)
    assert len(few) <= 120 and few.n.sum() == 600
    assert (few.n[:, None] * few.centre).sum(0) == pytest.approx(x.sum(0))
    from freshet.operators.clustering import adjusted_rand

    both = H.ward_regimes(df, 3, limit=120).select("series_id", "regime").join(H.ward_regimes(df, 3).select("series_id", "cluster"), "series_id")
    assert adjusted_rand(both, "regime", "cluster").first()["ari"] > 0.9


def test_copies_one_vector_and_empty_table(spark):
    x = np.concatenate([np.zeros((50, 2)), np.ones((50, 2)), np.full((3, 2), 9.0)])
    label, member = H.density_labels(H.Leaves.of(x), 10)
    assert as_sets(label, -1) == {frozenset(range(50)), frozenset(range(50, 100))} and (member[:100] == 1).all()
    assert len(H.Leaves.of(x).condensed(20)) == 3
    df = frame(spark, x)
    assert {r["end_member"] for r in H.density_members(df.limit(1), 10).collect()} == {-1}
    assert H.density_members(df.limit(0)).count() == 0 and H.ward_regimes(df.limit(0)).count() == 0
