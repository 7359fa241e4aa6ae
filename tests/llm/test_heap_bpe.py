"""Byte-level BPE against the library."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from freshet.llm import heap_bpe, queries
from freshet.llm.queries import tokenizer_file
from tests.llm.conftest import SF

PATH = tokenizer_file("byte_bpe_50k.json")
ALPHABET = [*"ab c  \n\t'sd.,!1²½٣éñ ́字漢😀ǅİſK\x85\x1c", "<|endoftext|>", "  ", "   ", " \n", "'ll", "the ", "\xa0", " \xa0", "\u1680", "\u2003", "\u2009", "\u2028", "\u202f", "\u3000"]


def texts():
    r = random.Random(1)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["x" * 30_000, " " * 5000 + "a", "ab " * 20_000, "a \xa0 \xa0 \xa0b"]


def test_ids_and_text_match_the_library():
    library, own = Tokenizer.from_file(PATH), heap_bpe.HeapBpe(open(PATH, "rb").read())
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<i4").tolist() == want
        assert own.decode(np.array(want, int)).decode() == library.decode(want, skip_special_tokens=False)


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(heap_bpe, "WORDS", 3)
    monkeypatch.setattr(heap_bpe, "CHUNKS", 2)
    spec = open(PATH, "rb").read()
    small = heap_bpe.HeapBpe(spec)
    library = Tokenizer.from_file(PATH)
    for t in texts()[:500]:
        assert np.frombuffer(small.encode(t), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_columns_nulls_and_empty_table(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("IDS", T.StringType())])
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "x"), (None, "é<|endoftext|>", None)], schema)
    out = heap_bpe.decode(heap_bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == 5 and all(x.decoded == (x.text or "") for x in rows)
    assert {len(x.ids) for x in rows if not x.text} == {0}
    odd = spark.createDataFrame([([50256, -1, 999_999, 50256],), (None,)], "ids array<int>")
    assert [x.decoded for x in heap_bpe.decode(odd, PATH).collect()] == ["<|endoftext|>" * 2, ""]
    assert heap_bpe.decode(heap_bpe.encode(df.limit(0), PATH), PATH).count() == 0


def test_round_trip_needs_one_worker_a_task(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (None, "é<|endoftext|>", None)], "doc_id bigint, text string, Decoded string")
    once, twice = heap_bpe.round_trip(df, PATH), heap_bpe.decode(heap_bpe.encode(df, PATH), PATH)
    assert once.columns == twice.columns and once.collect() == twice.collect()
    assert [x.text for x in heap_bpe.round_trip(df, PATH, decoded="text").collect()] == ["", "", "Hello  world", "é<|endoftext|>"]
    for made in (once, queries.op10_heap_bpe(spark, SF), corpus_pipeline.tokens(spark, df, SF)):
        assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_a_batch_is_decoded_in_one_run(monkeypatch):
    """Ids that the vocabulary lacks, null lists, slices and ids that end inside a character, without a text at a time."""
    own = heap_bpe.HeapBpe(open(PATH, "rb").read())
    inside = np.frombuffer(own.encode("漢😀"), "<i4").tolist()
    lists = [[1], inside, None, [], [50256, -1, None, 999_999, 50256], inside[:1], inside[:-1] + inside, [0]]
    want = [b"" if x is None else own.decode(np.array([-1 if i is None else i for i in x], int)) for x in lists]
    assert any("�" in x.decode() for x in want)
    monkeypatch.setattr(heap_bpe.HeapBpe, "decode", None)
    column = pa.array(lists, pa.list_(pa.int32()))
    for a, b in ((0, 8), (1, 5), (2, 7), (2, 3), (3, 3), (0, 2)):
        assert [x.as_py().encode() for x in heap_bpe._decoded(own, column.slice(a, b - a))] == want[a:b]
