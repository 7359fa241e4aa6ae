"""Exact clusters against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from freshet.llm import bit_planes as B

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])


def plain(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), (o, _) in zip(kept, own) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    return sorted((-1 if i is None else i, c, d, sum(e for o, e in own if o == c), sum(e for _, e in own), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, own))


def vectors():
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(64)]) for i in range(150)]
    rows += [(200 + i, [round(x, 1) for x in rows[i][1]]) for i in range(40)]
    rows += rows[:20] + [(300 + i, [0.0] * 64) for i in range(30)] + [(None, rows[3][1])]
    bad = [(400, None), (401, []), (402, [1.0] * 63), (403, [float("nan")] * 64), (404, [None] + [1.0] * 63), (405, [float("-inf")] * 64)]
    return rows + bad


def test_matches_plain_integers(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], SCHEMA).repartition(6)
    got = sorted((x.vec_id if x.vec_id is not None else -1, x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in B.described(*B.cluster(df)).collect())
    assert got == plain(rows)


def test_few_vectors_and_empty_table(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(1, 8)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], SCHEMA)
    got = sorted((x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in B.described(*B.cluster(df)).collect())
    assert got == plain(rows)
    assert B.described(*B.cluster(df.limit(0))).count() == 0
    with pytest.raises(ArithmeticError):
        B.cluster(spark.createDataFrame([(1, [1e9] * 64, "")], SCHEMA))


def test_dot_products_of_planes():
    r = np.random.default_rng(5)
    for top in (1, 7, 255, 1 << 20):
        x, y = (r.integers(-top - 1, top + 1, (50, 64)) for _ in range(2))
        width = int(top + 1).bit_length() + 1
        p, q = B.pack(x, width), B.pack(y, width)
        assert (B.unpack(p) == x).all()
        assert (B.dots(p, q) == (x * y).sum(axis=1)).all()
        assert (B.dots(p, q[0]) == x @ y[0]).all()
