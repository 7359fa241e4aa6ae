"""The pipeline's language stage keeps clean mixtures and unlabelled corpora."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm.queries import table


def test_even_mixtures_stay_and_noise_goes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    one = {x.lang: x.text for x in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    size = min(2000, *map(len, one.values()))
    r = random.Random(1)
    noise = "".join(r.choice("bcdfghjklmnpqrstvwxz\u0431\u0434\u0436\u0444\u0449\u044e") for _ in range(2000))
    rows = [(-1, " ".join(t[:size] for t in one.values()), None), (-2, noise, None), (-3, "12 -- !", None)]
    both = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = {x.doc_id for x in corpus_pipeline.language(spark, both, sf).select("doc_id").collect()}
    assert len(one) >= 3 and -1 in kept and -2 not in kept and -3 not in kept
    assert len(kept) == docs.count() + 1


def test_all_texts_pass_without_labels(spark, sf):
    docs = table(spark, sf, "documents").limit(50).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, sf).count() == 50
