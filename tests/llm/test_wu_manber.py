"""Multi-pattern search against a plain search over words."""

import random
import re

from pyspark.sql import types as T

from freshet.llm import wu_manber as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        p = plain_words(t)
        for i in range(max(1, len(p) - 12) if p else 0):
            part = p[i : i + 13]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def cases():
    r = random.Random(4)
    vocab = ["a", "the", "is", "Éa", "x9", "漢字", "word", "longerword", "ab"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "-", "_ "]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 5, 12, 13, 14, 30, 60]))) for i in range(40)] + [(40, None), (41, "..."), (42, "THE"), (43, "the")]
    docs = [None, "", "...", "the", "The end of the"]
    for _ in range(80):
        parts = [text(r.randint(0, 30)), r.choice(items)[1] or "", text(r.randint(0, 10)), (r.choice(items)[1] or "")[3:]]
        docs.append(" ".join(parts))
    return docs, items


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("Items", T.StringType())])


def test_search_matches_plain_search(spark, monkeypatch):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] * 2, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = [plain(t, items) for t in docs]
    for size in (W.BLOCK_BYTES, 300):  # one block, then several passes
        monkeypatch.setattr(W, "BLOCK_BYTES", size)
        got = W.search(df, bench).select("doc_id", "n_words", W.n_hit().alias("n"), "items", W.contaminated().alias("c")).collect()
        assert len(got) == 2 * len(docs)
        for x in got:
            assert (x.n_words, x.n, x["items"]) == want[x.doc_id]
            assert x.c == (x.n > 0 and 20 * x.n >= x.n_words)


def test_empty_tables_and_kept_columns(spark):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert W.search(df.limit(0), bench).count() == 0
    kept = W.decontaminate(df, bench)
    assert kept.schema == df.schema
    clean = {i for i, t in enumerate(docs) for n, h, _ in [plain(t, items)] if not (h and 20 * h >= n)}
    assert {x.doc_id for x in kept.collect()} == clean
    assert W.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(13))
    df = spark.createDataFrame([(1, "x " * 200_000 + item, "")], SCHEMA)
    got = W.search(df, spark.createDataFrame([(7, item)], "item_id bigint, text string")).first()
    assert (got.n_words, got["items"]) == (200_013, ["7"]) and [tuple(s) for s in got.spans] == [(200_000, 200_012)]
