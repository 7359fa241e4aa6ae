"""Language mixtures: held-out accuracy, mixtures, and defined cases."""

import collections
import math
import random

import regex
from pyspark.sql import functions as F

from freshet.llm import mixture_lang as M
from freshet.llm.queries import QUERIES, table


def test_held_out_accuracy(spark, sf):
    got = QUERIES["op4_mixture_lang"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.95
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_mixture_and_defined_cases(spark, sf):
    docs = table(spark, sf, "documents")
    model = M.train(docs)
    assert model.langs == sorted(x.lang for x in docs.select("lang").distinct().collect())
    one = {x.lang: x.text for x in docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    rows = [(1, None), (2, ""), (3, "12 -- !"), (4, one["en"][:3000] + " " + one["de"][:3000]), (5, one["fr"]), (5, one["fr"]), (6, one["es"] * 20)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, Score string")
    got = M.identify(df, model).collect()
    assert len(got) == len(rows) and M.identify(df, model).columns == ["doc_id", "text", "lang_pred", "score", "langs", "proportions"]
    by_id = {x.doc_id: x for x in got}
    assert all((by_id[i].lang_pred, by_id[i].score, by_id[i].langs) == ("und", 0.0, []) for i in (1, 2, 3))
    assert sorted(by_id[4].langs) == ["de", "en"] and 0.3 < by_id[4].score < 0.7 and abs(sum(by_id[4].proportions) - 1) < 1e-6
    assert (by_id[5].lang_pred, by_id[6].lang_pred) == ("fr", "es")
    assert M.identify(df, M.train(docs.limit(0))).where("lang_pred <> 'und'").isEmpty()
    assert M.identify(df.limit(0), model).count() == 0


def plain(text):
    words = regex.sub(r"[^\p{L}]+", " ", text.lower()).strip()
    s = f" {words} "
    return collections.Counter(s[i : i + 3] for i in range(len(s) - 2)) if words else collections.Counter()


def plain_em(rows, text):
    """Proportions of all languages and the log-likelihood, by plain loops over strings."""
    seen = collections.defaultdict(collections.Counter)
    for t, lang in rows:
        seen[lang] += plain(t)
    chance = (len({c for x in seen.values() for g in x for c in g}) + 1) ** -3
    langs, got = sorted(seen), plain(text)
    like = {x: {g: (seen[x][g] + len(seen[x]) * chance) / (sum(seen[x].values()) + len(seen[x])) for g in got} for x in langs}

    def fit(live, share):
        for _ in range(M.ROUNDS):
            new = {x: 0.0 for x in live}
            for g, n in got.items():
                mix = sum(share[x] * like[x][g] for x in live)
                for x in live:
                    new[x] += n * share[x] * like[x][g] / mix
            new = {x: v / sum(got.values()) for x, v in new.items()}
            done = max(abs(new[x] - share[x]) for x in live) < 1e-4
            share = new
            if done:
                break
        return share, sum(n * math.log(sum(share[x] * like[x][g] for x in live)) for g, n in got.items())

    live = langs
    share, best = fit(live, {x: 1 / len(live) for x in live})
    while len(live) > 1:
        fewer = [x for x in live if x != min(live, key=share.get)]
        total = sum(share[x] + 1e-6 for x in fewer)
        new, value = fit(fewer, {x: (share[x] + 1e-6) / total for x in fewer})
        if best - value > M.PENALTY * math.log(sum(got.values()) + 1):
            break
        live, share, best = fewer, new, value
    return share, best / sum(got.values()) - math.log(chance)


def test_both_ways_against_plain_loops(spark, sf):
    docs = table(spark, sf, "documents").where("length(text) < 2000 AND lang IS NOT NULL").orderBy("doc_id").limit(60)
    rows = [(x.text, x.lang) for x in docs.collect()]
    r = random.Random(4)
    texts = [t for t, _ in rows[:12]] + [r.choice(rows)[0] + " " + r.choice(rows)[0] for _ in range(6)] + ["qqq \u4e2d\u6587\U0001f600", "", None, rows[0][0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row int, text string, Score string")
    held, wide = M.train(docs), M.train(docs, cells=0)
    assert held.table is not None and wide.table is None
    a, b = ({x.row: x for x in M.identify(df, m, fit="gain").collect()} for m in (held, wide))
    assert len(a) == len(b) == len(texts) and M.identify(df, wide).columns == M.identify(df, held).columns
    for i, t in enumerate(texts):
        x, y = a[i], b[i]
        assert x.lang_pred == y.lang_pred and x.langs == y.langs
        assert all(abs(u - v) < 1e-9 for u, v in zip([x.score, *x.proportions, x.gain or 0], [y.score, *y.proportions, y.gain or 0]))
        if not t:
            assert (x.lang_pred, x.score, x.langs, x.gain) == ("und", 0.0, [], None)
            continue
        share, gain = plain_em(rows, t)
        assert set(x.langs) == set(share) and abs(x.gain - gain) < 1e-6
        assert all(abs(share[lang] - p) < 1e-6 for lang, p in zip(x.langs, x.proportions))


def test_counts_pass_on_what_a_task_cannot_hold(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").where("length(text) < 2000").limit(40)
    whole = {(x.lang, x.gram): x.n for x in M.counts(docs).collect()}
    monkeypatch.setattr(M, "HELD", 50)
    assert {(x.lang, x.gram): x.n for x in M.counts(docs).collect()} == whole
