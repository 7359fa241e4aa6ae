"""Graph search against brute force."""

import numpy as np
from pyspark.sql import types as T

from freshet.llm import pruned_graph as G
from freshet.llm.queries import QUERIES, table

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType())])


def nearest(rows, query, k=10):
    name, q = query
    d = sorted((float(np.sqrt(((np.array(v, float) - np.array(q, float)) ** 2).sum())), i) for i, v in rows if i != name and len(v) == len(q))
    return d[:k]


def test_recall_on_the_table(spark, sf):
    got = {}
    for x in QUERIES["op3_pruned_graph"](spark, sf).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.score, x.vec_id)
    rows = [(x.vec_id, x.embedding) for x in table(spark, sf, "embeddings").collect()]
    queries = [r for r in rows if r[0] % 100 == 0]
    hits = total = 0
    for q in queries:
        want = nearest(rows, q)
        mine = [got[q[0]][r] for r in range(1, len(want) + 1)]
        assert mine == sorted(mine)
        hits += len({i for _, i in want} & {i for _, i in mine})
        total += len(want)
    assert set(got) == {q[0] for q in queries} and hits / total >= 0.95


def test_copies_ties_shards_and_bad_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(200)] + [(2000, [1.0, 2.0])]
    bad = [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [1.0, None] * 4), (3005, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad + rows[:5]], SCHEMA)
    pts = G.points(df)
    assert pts.count() == len(rows)
    graph = G.index(pts, shard_size=60)
    got = {}
    for x in G.search(graph, pts.where("vec_id % 50 = 0"), block_size=4).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.score, x.vec_id)
    for q in (x for x in rows if x[0] % 50 == 0):
        want = nearest(rows, q)
        assert [got.get(q[0], {}).get(i + 1) for i in range(len(want))] == want
    assert G.search(G.index(pts.limit(0)), pts.limit(0)).count() == 0
