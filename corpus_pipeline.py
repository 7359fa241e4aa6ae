"""A corpus pipeline of five stages over ``documents``.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns documents:

1. language: documents of no language (no letters, or trigrams that all its languages explain worse than chance) go;
2. lines: copies and near copies of earlier lines are taken out of the texts;
3. near-duplicates: of each group of similar fingerprints the smallest doc_id stays;
4. benchmark: documents with at least one word in twenty inside benchmark windows go;
5. tokens: every text is encoded, and the ids and their decoded text are added.

The language model is learned from the stage's own labelled documents, and lang never enters a
prediction.  Empty tables, null texts and extra columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.lineage import scratch_folder
from freshet.llm import fuzzy_lines, golay, heap_bpe, mixture_lang, wu_manber
from freshet.llm.queries import table, tokenizer_file

ORACLE_SQL = None  # neither mixtures, shingles nor fingerprints can be put as SQL; the tests compare with plain loops


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mixture_lang.train(docs)
    if not model.langs:  # nothing was learned, so nothing can be judged
        return docs
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return mixture_lang.identify(own, model, fit="fit").where(mixture_lang.accepted()).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim = fuzzy_lines.deduplicate(docs)
    return slim.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else slim


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wu_manber.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return heap_bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
