"""Golay keys, fingerprints and components against plain loops."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import types as T

from freshet.llm import golay
from freshet.llm.components import components


def test_words_two_bits_apart_share_a_key():
    g = golay.Golay()
    assert (np.bincount(g.count) > 0).tolist() == [False, True, False, False, False, False, True]
    # Adding a codeword moves all keys alike, so one word of every syndrome stands for all words.
    words = np.array([g.errors[s, 0] for s in range(2048)])
    keys, count = g.keys(words)
    own = [set(k[:n]) for k, n in zip(keys, count)]
    for pattern in [1 << i for i in range(23)] + [1 << i | 1 << j for i, j in combinations(range(23), 2)]:
        k, n = g.keys(words ^ pattern)
        assert all(own[i] & set(k[i][: n[i]]) for i in range(2048))


def test_prints_four_bits_apart_share_a_bucket():
    r, g = random.Random(3), golay.Golay()
    a = np.array([r.getrandbits(64) for _ in range(300)], "<u8")
    b = np.array([int(x) ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for x in a], "<u8")
    sets = []
    for x in (a, b):
        keys, rows = golay.bucket_keys(x, g)
        sets.append([set(keys[rows == i]) for i in range(len(x))])
    assert all(p & q for p, q in zip(*sets))


def plain_print(text):
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - 3)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(prints):
    ids = list(range(len(prints)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            ids[b] = a
    return [find(i) for i in range(len(prints))]


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("fp", T.StringType()), ("component_id", T.LongType()))])


def test_groups_match_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(200)]
    texts = [None, "", " \n\t", "One two", "one TWO", "a b c d", "é è x y z"]
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(30, 300))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(" ".join(copy))
    texts += [texts[10]] * 40 + ["long " * 20000 + "end"]
    prints = [plain_print(t) for t in texts]
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(texts)], SCHEMA)
    got = {x.doc_id: x for x in golay.groups(df).collect()}
    assert len(got) == len(texts)
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == prints
    want = plain_components(prints)
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = golay.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e", "", 0), (1, "a b c d e", "", 0), (None, "a b c d e", "", 0), (None, "other words here now", "", 0)], SCHEMA)
    assert sorted(x.component_id or -1 for x in golay.groups(df).collect()) == [-1, 1, 1, 1]
    assert sorted((x.doc_id or -1, x.text) for x in golay.deduplicate(df).collect()) == [(-1, "other words here now"), (1, "a b c d e")]
    # An id that repeats with another text: each text keeps one row.
    a, b = "a b c d e f g h", "other words in this one here now"
    again = spark.createDataFrame([(1, a, "", 0), (5, a, "", 0), (5, b, "", 0), (9, b, "", 0), (None, a, "", 0), (None, a, "", 0), (9, b, "", 0)], SCHEMA)
    assert sorted((x.doc_id, x.text) for x in golay.deduplicate(again).collect()) == [(1, a), (5, b)]
    alone = spark.createDataFrame([(None, a, "", 0), (None, a, "", 0), (None, a, "x", 0)], SCHEMA)
    assert [(x.doc_id, x.text) for x in golay.deduplicate(alone).collect()] == [(None, a)]
    assert golay.groups(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(7, 7)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_many_empty_texts_and_one_large_component(spark):
    """A hot fingerprint and a hot component are spread, and nothing is lost."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, "", "", 0) for i in range(100_000)]
    rows += [(200_000 + i, " ".join([*base[:-1], f"x{i}"]), "", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = golay.groups(df).groupBy("component_id").count().collect()
    assert {x["component_id"]: x["count"] for x in got} == {0: 100_000, 200_000: 3000}
    assert sorted(x.doc_id for x in golay.deduplicate(df).collect()) == [0, 200_000]
