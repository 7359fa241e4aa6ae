"""Grammar compression: exact round trips, random access, files and ids against the library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from freshet.llm import repair
from freshet.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("base", [300, 49408, 65535, 100_000])
def test_round_trip_and_random_access(base):
    r = np.random.default_rng(3)
    for ids in (r.integers(0, 20, 30_000), np.zeros(5000, int), np.tile([1, 2, 3], 4000), r.integers(0, base, 1000), np.array([], int), np.array([5])):
        row = repair._shard_row(0, 0, [1], [len(ids)], ids, 4, base, 8)
        shard = repair.Shard(row)
        assert (shard.ids() == ids).all()
        assert (shard.rule_lengths == [len(repair.expand(np.array([base + i]), shard.rules, base)) for i in range(len(shard.rules))]).all()
        for _ in range(20):
            if len(ids):
                a = int(r.integers(0, len(ids)))
                n = int(r.integers(0, len(ids) - a)) + 1
                assert (shard.ids_at(a, n) == ids[a : a + n]).all()
    assert len(repair.compress(np.tile([1, 2, 3], 4000), base, 8)[2]) < 200


def test_encoder_matches_the_library():
    from tests.llm.test_heap_bpe import texts

    library, own = Tokenizer.from_file(PATH), repair.Encoder(open(PATH, "rb").read(), limit=50)
    some = [t[:2000] for t in texts()] + ["Erth, erth. ERTH! it's I'LL", "<|STARTOFTEXT|> <|startoftext|>a."]
    for t, got in zip(some, own.encode(some)):
        assert np.frombuffer(got, own.kind).tolist() == library.encode(t, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    docs = [(i * 7 % 101, f"word{i} the the, and {i}. " * (i % 5)) for i in range(101)] + [(500, None), (501, ""), (501, "twice"), (502, "long " * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, start string")
    repair.write(df, PATH, str(tmp_path / "s"), shard_ids=500, min_count=4)
    got = sorted(repair.read(spark, str(tmp_path / "s")).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted(i for i, _ in docs)
    at, by_id = 0, {}
    for i, t in docs:
        by_id.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    for x in got:
        assert x.start == at and x.n_tokens * 4 == len(x.ids_le)
        assert np.frombuffer(x.ids_le, "<u4").tolist() in by_id[x.doc_id]
        at += x.n_tokens
    assert zlib.crc32(bytes(got[0].ids_le)) == zlib.crc32(np.array(by_id[got[0].doc_id][0], "<u4").tobytes())
    repair.write(df.limit(0), PATH, str(tmp_path / "e"))
    assert repair.read(spark, str(tmp_path / "e")).count() == 0


class Counted:
    """A tokenizer that counts the texts it encodes."""

    def __init__(self, tool):
        self.tool, self.n = tool, 0

    def encode_batch_fast(self, texts, **more):
        self.n += len(texts)
        return self.tool.encode_batch_fast(texts, **more)


def test_new_words_are_encoded_together():
    library, own = Tokenizer.from_file(PATH), repair.Encoder(open(PATH, "rb").read())
    own.plain, own.tokenizer = Counted(own.plain), Counted(own.tokenizer)
    words = [f"{a}{b}{c}" for a in ("th", "ÉÀ", "ß", "qx") for b in ("tion", "ou", "ñ", "erst") for c in ("", "a", "ed", "ier")]
    marks = ["", ".", ",%%%", "!!", "&&&", "?)", "-", "=", "'s", "'", "<", "÷", "×!", "7", "\t."]
    texts = [" ".join(w + m for w in words) for m in marks]
    for t, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, own.kind).tolist() == library.encode(t, add_special_tokens=False).ids
    assert own.plain.n == 1  # one text of 64 words
    assert own.tokenizer.n <= 7 * len(words) + len(marks)  # only words with an odd mark, and the marks
    again = own.plain.n, own.tokenizer.n
    own.encode(texts)
    assert (own.plain.n, own.tokenizer.n) == again


def test_last_rules_use_up_the_room():
    ids, base = np.random.default_rng(4).integers(0, 200, 200_000), 49_408
    rules, lens, seq = repair.compress(ids, base)
    assert base + len(rules) == 1 << 16 and len(seq) < 126_500  # 126,020
    assert len(np.unique(seq[seq >= base])) + len(np.unique(rules[rules >= base])) >= len(rules)
    assert (repair.expand(seq, rules, base) == ids).all()
