"""Links and components of vectors against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from freshet.llm import pca_tiles as P

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("vec_id", T.LongType()), ("embedding", T.ArrayType(T.FloatType())), ("label", T.IntegerType()), ("tile", T.StringType()), ("n", T.LongType()))])


def plain(rows, least=0.93):
    n = len(rows)
    good = [lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links, near = [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    near[i].add(j), near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def vectors(dim=24, many=420):
    r = np.random.default_rng(6)
    lead = np.ones(dim)
    lead[:3] = 6  # a few axes that vary more
    rows = []
    while len(rows) < many:
        base = r.normal(size=dim) * lead
        for _ in range(random.Random(len(rows)).choice([1, 1, 1, 2, 5, 30])):
            rows.append((len(rows), (base + r.normal(size=dim) * r.choice([0.02, 0.3, 1.0])).tolist(), int(r.integers(0, 3)) if r.random() < 0.4 else 0))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]  # exact copies
    rows += [(2000, [2 * x for x in rows[5][1]], rows[5][2]), (2001, rows[5][1][:-1], rows[5][2]), (None, rows[5][1], rows[5][2]), (None, rows[5][1], 9), (3, rows[9][1], rows[9][2])]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * dim, 0), (3003, [float("nan")] * dim, 0), (3004, [None] * dim, 0), (3005, [float("inf")] * dim, 0), (3006, rows[5][1], None), (3007, [1e30] * dim, 4), (3008, [1e-30] * dim, 4)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("tile,partners", [(2048, 8), (16, 2)])
def test_matches_all_pairs(spark, monkeypatch, tile, partners):
    monkeypatch.setattr(P, "TILE", tile)
    monkeypatch.setattr(P, "PARTNERS", partners)
    rows = vectors()
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in P.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = plain(rows)
    assert sum(w[1] > 0 for w in want) > 100
    # A row without an id and without links stays.
    assert got == sorted(((i, n, c, k if i is not None or c is not None else True) for i, n, c, k in want), key=str)


def test_cells_and_boxes_lose_no_link():
    r = np.random.default_rng(1)
    for dim in (1, 2, 3, 8, 40, 100):
        x = r.normal(size=(300, dim))
        y = np.concatenate([x[:100] + r.normal(size=(100, dim)) * 0.3, r.normal(size=(100, dim))])
        axes = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        a, b = P.Side(x, axes), P.Side(y, axes)
        i, j = P.linked_pairs(a, b, 0.93)
        c = P.units(x) @ P.units(y).T
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(c >= 0.93))))


def test_pairs_at_the_threshold(spark):
    """Cosine of exactly 0.5, just above and just below, decided on the original numbers."""
    rows = [(1, [1.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 1.0], 0), (3, [1.0, 0.0, 0.0], 1), (4, [0.49999, 0.8660312, 0.0], 1), (5, [0.50001, 0.8660196, 0.0], 2), (6, [1.0, 0.0, 0.0], 2)]
    a, b = (np.array([v]) for _, v, lab in rows[:2])
    exact = float(P.cosines(a, b)[0]) >= 0.5
    got = {x.vec_id: x.n_links for x in P.near_duplicates(frame(spark, rows), threshold=0.5).collect()}
    assert got == {1: int(exact), 2: int(exact), 3: 0, 4: 0, 5: 1, 6: 1}


def test_empty_table_and_doubles(spark):
    df = frame(spark, vectors()[:3])
    assert P.near_duplicates(df.limit(0)).count() == 0
    twice = df.select("vec_id", df["embedding"].cast("array<double>").alias("embedding"), "label").union(df.selectExpr("vec_id + 500", "cast(embedding as array<double>)", "label"))
    assert sorted(x.component_id for x in P.near_duplicates(twice).collect() if x.n_links) == sorted(2 * [x.component_id for x in P.near_duplicates(twice).collect() if x.vec_id < 500])
