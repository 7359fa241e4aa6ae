"""URL models against plain counting."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import url_lm as U
from freshet.llm.queries import RULES


def plain_ratio(urls):
    """Ratios per gram from (url, acc, rej) by the recursion of the smoothing itself."""
    count = {c: Counter() for c in ("acc", "rej")}
    for u, acc, rej in urls:
        p = U.START * U.ORDER + "".join(ch if "\x21" <= ch <= "\x7e" else "\x7f" for ch in u)
        for i in range(U.ORDER, len(p)):
            count["acc"][p[i - U.ORDER : i + 1]] += acc
            count["rej"][p[i - U.ORDER : i + 1]] += rej
    model = {}
    for c, grams in count.items():
        levels = [Counter() for _ in range(U.ORDER + 1)]
        for g, n in grams.items():
            for k in range(U.ORDER + 1):
                levels[k][g[U.ORDER - k :]] += n
        follow = [defaultdict(list) for _ in levels]
        for k, level in enumerate(levels):
            for s, n in level.items():
                follow[k][s[:-1]].append(n)

        def chance(g, levels=levels, follow=follow):
            p = 1 / U.SYMBOLS
            for k in range(U.ORDER + 1):
                s = g[U.ORDER - k :]
                n, kinds = sum(follow[k][s[:-1]]), sum(x > 0 for x in follow[k][s[:-1]])
                p = (levels[k][s] + kinds * p) / (n + kinds) if n + kinds else p
            return p

        model[c] = chance
    return {g: math.log(model["acc"](g)) - math.log(model["rej"](g)) for g in count["acc"]}


def test_ratios_match_plain_counting(spark):
    urls = [("http://a.net/x", 0, 2), ("http://b.org/fr/1", 3, 0), ("http://c.com/é", 0, 0), ("https://b.org/fr/22", 1, 0)]
    df = spark.createDataFrame(urls, "url string, acc bigint, rej bigint")
    counts = U.grams(df, U.ORDER, ["acc", "rej"]).groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    got = {x.gram: x.ratio for x in U.log_ratios(counts).collect()}
    want = plain_ratio(urls)
    assert set(got) == set(want)
    assert all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)


def test_hosts_paths_rules(spark):
    rows = [
        (1, "https://Sub.Example.NET/en/1?q#f", "sub.example.net", "/en/1", "example.net/en/", "allow"), (2, "http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        (3, "http://a.net", "a.net", "", None, None), (4, "http://notnet/x", "notnet", "/x", None, None), (5, None, "", "", None, None), (6, "no scheme", "", "", None, None),
        (7, "x://w.org/fr/a?b=://c", "w.org", "/fr/a", "org/fr/", "allow"), (8, "http://www.example.com/de/#t", "www.example.com", "/de/", "example.com/de/", "block"),
        (9, "", "", "", None, None), (10, "http://ÉA.net/", "Éa.net", "/", "net/", "block"), (1, "https://Sub.Example.NET/en/1?q#f", "sub.example.net", "/en/1", "example.net/en/", "allow"),
        (11, "http://l.com/" + "a" * 20_000, "l.com", "/" + "a" * 20_000, None, None),
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u, *_ in rows], "page_id bigint, url string, Rule string")
    got = U.judge(df, RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    want = {i: r for i, *r in rows}
    for x in found:
        _, host, path, rule, said = want[x.page_id]
        assert (x.host, x.path, x["rule"]) == (host, path, rule) and x.verdict in ("allow", "block") and (said is None or x.verdict == said)
        assert x.verdict == "allow" or x.url
    assert U.judge(df.limit(0), RULES).count() == 0
    assert {(x.verdict, x.score) for x in U.judge(df.where("page_id IN (4, 6)"), RULES).collect()} == {("allow", 0.0)}
