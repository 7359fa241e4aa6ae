"""The pipeline on a small corpus, stage by stage against plain loops."""

import random

from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from freshet.llm.queries import table, tokenizer_file
from tests.llm.test_fuzzy_lines import plain as plain_lines
from tests.llm.test_golay import plain_components, plain_print
from tests.llm.test_wu_manber import plain as plain_search


def corpus(spark, sf):
    r = random.Random(6)
    base = [(x.text, x.lang) for x in table(spark, sf, "documents").where("n_chars < 1500").orderBy("doc_id").limit(60).collect()]
    bench = [(x.item_id, x.text) for x in table(spark, sf, "benchmark").orderBy("item_id").limit(10).collect()]
    docs = list(base)
    docs += [(t + " " + t.split(" ")[0], lang) for t, lang in base[:10]]
    docs += [base[3]] * 15 + [(base[0][0] + "\n" + bench[0][1], "en"), (bench[1][1], "en"), (None, "en"), ("", "fr"), ("123 ...", None), ("\n\n", "es")]
    r.shuffle(docs)
    return [(i, t, lang, "s", len(t or ""), i % 3) for i, (t, lang) in enumerate(docs)], bench


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("row", T.IntegerType()))])


def test_stages_match_plain_loops(spark, sf, tmp_path):
    rows, bench = corpus(spark, sf)
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append({x.doc_id: x for x in docs.collect()})
        assert docs.count() == len(seen[-1])
    texts = {i: t for i, t, *_ in rows}
    language, lines, unique, clean, tokens = seen
    assert set(texts) - set(language) == {i for i, t in texts.items() if not any(c.isalpha() for c in t or "")}
    ids = sorted(language)
    assert [lines[i].text for i in ids] == plain_lines([language[i].text for i in ids])
    comps = plain_components([plain_print(lines[i].text) for i in ids])
    assert set(unique) == {ids[j] for j in set(comps)}
    bad = {i for i, x in unique.items() for n, h, _ in [plain_search(x.text, bench)] if h and 20 * h >= n}
    assert bad and set(clean) == set(unique) - bad
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for i, x in tokens.items():
        assert x.ids == library.encode(x.text, add_special_tokens=False).ids and x.decoded == x.text
    assert set(tokens) == set(clean)
    whole = corpus_pipeline.run(spark, folder)
    assert {x.doc_id: x.ids for x in whole.collect()} == {i: x.ids for i, x in tokens.items()}


def test_empty_table(spark, sf, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
