"""Fuzzy line deduplication against a loop over all pairs of lines."""

import random
from itertools import combinations, product

from pyspark.sql import types as T

from freshet.llm import fuzzy_lines as L

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("line", T.StringType()), T.StructField("_key", T.LongType())])


def plain(texts):
    """Texts by id, in id order."""
    places = [(i, j, s.strip(L.WHITE)) for i, t in enumerate(texts) for j, s in enumerate((t or "").split("\n")) if s.strip(L.WHITE)]
    lines = sorted({s for _, _, s in places})
    up = {s: s for s in lines}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    sets = {s: L.shingles(s) for s in lines}
    for a, b in combinations(lines, 2):
        if L.similar(sets[a], sets[b]):
            up[find(a)] = find(b)
    first, drop = {}, set()
    for i, j, s in places:
        if first.setdefault(find(s), (i, j)) != (i, j):
            drop.add((i, j))
    return [None if t is None else "\n".join(s for j, s in enumerate(t.split("\n")) if (i, j) not in drop) for i, t in enumerate(texts)]


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    fresh = lambda: " ".join(word() for _ in range(r.randint(6, 30)))
    pool = [fresh() for _ in range(12)] + ["ab", "abcd", "é漢字 one two three four five"]

    def near(s):
        w = s.split(" ")
        w[r.randrange(len(w))] = word()
        return " ".join(w)

    texts = [None, "", "\n\n", "  \t"]
    for _ in range(60):
        texts.append("\n".join(r.choice([fresh, lambda: r.choice(pool), lambda: near(r.choice(pool)), lambda: " " + r.choice(pool) + "\t", lambda: ""])() for _ in range(r.randint(1, 8))))
    return texts + [texts[10]] * 25 + ["x" * 50_000 + "\n" + "x" * 50_001]


def test_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in enumerate(texts)], SCHEMA)
    out = L.deduplicate(df)
    assert out.columns == df.columns
    got = {x.doc_id: x for x in out.collect()}
    assert [got[i].text for i in range(len(texts))] == plain(texts)
    assert all(x.line == "c" and x._key == 5 for x in got.values())


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one line here", "", 0), (3, "one line here\nother", "", 0), (4, None, "", 0)], SCHEMA)
    assert {x.doc_id: x.text for x in L.deduplicate(df).collect()} == {None: "one line here", 3: "other", 4: None}
    assert L.deduplicate(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "same text", "", 0), (1, "same text", "", 0)], SCHEMA)
    assert sorted(x.text for x in L.deduplicate(twice).collect()) == ["", "same text"]
    rows = [(None, "some words\n\nand more of them", "", 0)] * 3 + [(None, "some words\n\nand more of them", "z", 0)] * 2 + [(7, "a line of its own", "", 0), (7, None, "", 0), (7, None, "", 0)]
    got = sorted((x.doc_id or -1, "-" if x.text is None else x.text, x.line) for x in L.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [x[:2] for x in got[:5]] == [(-1, "")] * 4 + [(-1, "some words\n\nand more of them")] and [x[2] for x in got[:5]].count("z") == 2
    assert got[5:] == [(7, "-", ""), (7, "-", ""), (7, "a line of its own", "")]


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 16)
    df = spark.createDataFrame([(None, "the very same line", "", 0)] * 1000 + [(2, "the very same line", "", 0)], SCHEMA)
    got = [x.text for x in L.deduplicate(df).collect()]
    assert len(got) == 1001 and sorted(got)[-2:] == ["", "the very same line"]


def test_crowded_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    r = random.Random(2)
    base = [f"word{r.randint(100, 999)}" for _ in range(40)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"word{r.randint(100, 999)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {x.doc_id: x.text for x in L.deduplicate(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_near_copies_by_five_character_shingles(spark):
    """Pairs of lines against sets of five characters that are written out here, not taken from the module."""
    r = random.Random(4)
    five = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    pairs = []
    for n in range(40, 130):
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
        a = f"x{a}y"
        k = 1 if n < 80 else 6  # a changed character, or a replaced word
        pairs.append((a, a[: n // 2] + "#" * k + a[n // 2 + k :]))
    near = [len(five(a) & five(b)) >= 0.8 * len(five(a) | five(b)) for a, b in pairs]
    assert near[:9] == [False] * 9 and all(near[9:40]) and any(near[40:]) and not all(near[40:])
    df = spark.createDataFrame([(i, f"{a}\n{b}", "", 0) for i, (a, b) in enumerate(pairs)], SCHEMA)
    got = {x.doc_id: x.text for x in L.deduplicate(df).collect()}
    assert [got[i] for i in range(len(pairs))] == [a if n else f"{a}\n{b}" for n, (a, b) in zip(near, pairs)]


def test_links_between_components_against_all_pairs(monkeypatch):
    r = random.Random(8)
    for _ in range(200):
        base = ["".join(r.choice("abcd ") for _ in range(40)) for _ in range(4)]
        lines = list({"".join(r.choice("abcd") if r.random() < 0.02 else c for c in r.choice(base)) for _ in range(r.randint(2, 30))})
        comps = [r.randint(0, 5) for _ in lines]
        sets = [{s[i : i + 5] for i in range(36)} for s in lines]

        def classes(links):
            up = {c: c for c in comps}
            for i, j in links:
                a, b = up[comps[i]], up[comps[j]]
                up = {c: min(a, b) if u in (a, b) else u for c, u in up.items()}
            return up

        all_pairs = [(i, j) for i in range(len(lines)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        monkeypatch.setattr(L, "FEW", r.choice([0, 64]))
        found = L.spanning(lines, comps)
        assert set(found) <= {(i, j) for x in all_pairs for i, j in (x, x[::-1])}
        assert classes(found) == classes(all_pairs)


def test_marks_rule_out_no_similar_pair():
    """Every pair of shingle sets with a similarity of 0.8 passes; repeats, short and very long lines included."""
    r = random.Random(6)
    ruled_out = 0
    for n in (3, 5, 9, 30, 80, 400, 3000):
        for alphabet in ("ab", "abcdefghij \u6f22"):
            base = "".join(r.choice(alphabet) for _ in range(n))
            lines = [base, base + base, ""] + ["".join(r.choice(alphabet) if r.random() < p else c for c in base) for p in (0.002, 0.01, 0.03, 0.1, 0.3) for _ in range(6)]
            sets = [{s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in lines]
            for (runs, words), (i, j) in product((L.marks(lines), L.wide_marks(lines)), combinations(range(len(lines)), 2)):
                possible = L.near_marks(sum((int(a) ^ int(b)).bit_count() for a, b in zip(words[i], words[j])), int(runs[i] + runs[j]))
                assert possible or 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j])
                ruled_out += not possible
    assert ruled_out > 1000


def test_pairs_counted_together_match_sets():
    r = random.Random(9)
    for letters in ("ab", "abcdefgh \0", "é漢😀ab\0", [chr(i) for i in range(0x4E00, 0x5E00)]):
        for n in (1, 2, 256):
            x = ["".join(r.choice(letters) for _ in range(r.choice((1, 2, 3, 4, 5, 6, 30, 100)))) for _ in range(n)]
            y = [r.choice((s, s[:-1] + r.choice(letters), s + "\0", s + s)) for s in x]
            assert L.similar_pairs(x, y).tolist() == [L.similar(L.shingles(a), L.shingles(b)) for a, b in zip(x, y)]


def test_a_small_bucket_is_dealt_once(spark, monkeypatch):
    lines = [f"{i} " + "the same end of every line" for i in range(6)]
    nodes = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "node bigint, line string")
    dealt, real = [], L._grouped
    monkeypatch.setattr(L, "_grouped", lambda rows, *more: dealt.append(rows.count()) or real(rows, *more))
    mixed = nodes.selectExpr("7L as key", "node", "if(node < 3, 0L, node) as comp", "0L as main", "6L as size", "3L as rest")
    runs, words = L.marks(lines)
    marked = spark.createDataFrame([(i, int(n), *w) for i, (n, w) in enumerate(zip(runs, words.view("<i8").tolist()))], "node bigint, runs bigint, " + ", ".join(f"{m} bigint" for m in L.MARKS))
    links = L._across(mixed, marked, lambda some: nodes).collect()
    assert dealt == [6, 6]
    joined = {0}
    for _ in lines:
        joined |= {c for a, b in links for c in ({0 if a < 3 else a, 0 if b < 3 else b}) if joined & {0 if a < 3 else a, 0 if b < 3 else b}}
    assert joined == {0, 3, 4, 5}


def test_unrelated_lines_rarely_share_a_band():
    """Lines of few syllables agree often in short bands; shared keys must not outgrow the lines."""
    r = random.Random(3)
    syllables = "th in er on an ea ti or st en of and the ing ion nd sh wh".split()
    lines = [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(30)) for _ in range(4000)]
    keys = L.band_keys(lines)
    again = [len(keys) - len(set(keys[:, band].tolist())) for band in range(keys.shape[1])]
    assert sum(again) < len(lines) // 20
    assert 1 - (1 - 0.8**L.ROWS) ** L.BANDS > 0.998
    assert (L.band_keys(lines[:50]) == keys[:50]).all() and (L.band_keys(lines[7:8]) == keys[7:8]).all()
