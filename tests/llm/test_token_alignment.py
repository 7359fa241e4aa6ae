"""Alignment of two tokenizers against loops over whole texts and the libraries' own ids."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from freshet.llm import token_alignment as A
from freshet.llm.heap_bpe import byte_letters
from freshet.llm.queries import tokenizer_file

BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("pairs", T.StringType()), ("ROW", T.LongType()))])
ALPHABET = [*"ab c  \n\t'sd.,!1²½٣éñ ́字漢😀ǅİ\x85\x1c\xa0", "<|endoftext|>", "<s>", "<0x41>", "  ", "   ", " \n", "'ll", "the ", "▁", " ", "　", "tion ", "\x00"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    spelled = {i: bytes(byte_of[c] for c in t) for t, i in json.load(open(BPE))["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return lambda t: [(i, spelled[i]) for i in a.encode(f" {t}", add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in b.encode(t)]


def plain(libraries, texts):
    """Per text: numbers and digest, by ranges of bytes."""
    docs = []
    for t in texts:
        sides = []
        for side in libraries if t else ():
            at, tokens = 0, []
            for i, s in side(t):
                tokens.append((i, at, at + len(s)))
                at += len(s)
            sides.append((tokens, b"".join(s for _, s in side(t))))
        whole = f" {t}".encode()
        docs.append((sides[0][0], sides[1][0]) if sides and sides[0][1] == sides[1][1] == whole else ([], []))
    links = [[(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])] for a, b in docs]
    count = Counter(p for doc in links for p in set(doc))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (a, b), own in zip(docs, links):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if lo < x[2] <= hi) for side in (a, b)))
            lo = hi
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(ends), len(own), digest, sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own)))
    return out


def texts():
    r = random.Random(1)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(300)]
    return [None, "", " ", "a", "a b", " a", "a ", *made, made[7], made[7], "x" * 3000, "word " * 500 + "end"]


@pytest.mark.parametrize("hot", [A.HOT, 40, 0])
def test_matches_loops(spark, libraries, hot):
    """With all pairs in the broadcast, some of them, and none."""
    t = texts()
    df = spark.createDataFrame([(i, x, "c", 3) for i, x in enumerate(t)], SCHEMA).repartition(5)
    got = {x.doc_id: x for x in A.align(df, BPE, PIECES, hot=hot).collect()}
    assert len(got) == len(t)
    want = plain(libraries, t)
    assert sum(w[0] == 0 for w in want) > 2
    for i, w in enumerate(want):
        x = got[i]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256, x.n_best, x.count_sum) == w, t[i]


def test_cut_texts_have_the_ids_of_whole_texts(libraries):
    import numpy as np

    pair = A.Pair(open(BPE, "rb").read(), open(PIECES, "rb").read())
    r = random.Random(4)
    for _ in range(5000):
        t = "".join(r.choice(ALPHABET) for _ in range(r.randint(1, 30)))
        a, b = (side(t) for side in libraries)
        same = b"".join(s for _, s in a) == b"".join(s for _, s in b) == f" {t}".encode()
        found = pair.tokens([t])[0]
        assert np.frombuffer(found[0], "<i4").tolist() == ([i for i, _ in a] if same else [])
        assert np.frombuffer(found[1], "<i4").tolist() == ([i for i, _ in b] if same else [])


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "the same text", "", 0), (None, "the same text", "", 0), (3, None, "", 0)], SCHEMA)
    got = sorted((x.doc_id or -1, x.n_a > 0, x.count_sum == 2 * x.n_links) for x in A.align(df, BPE, PIECES).collect())
    assert got == [(-1, True, True), (-1, True, True), (3, False, True)]
    assert A.align(df.limit(0), BPE, PIECES).count() == 0
