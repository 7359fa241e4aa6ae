"""Queries over the training-data tables: one per operator, and the pipeline."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import scratch_folder
from . import bit_planes, fuzzy_lines, golay, heap_bpe, mixture_lang, pca_tiles, preference, pruned_graph, repair, rule_ensemble, token_alignment, url_lm, wu_manber
from .common import crc_share, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A file of the public tokenizers; FRESHET_TOKENIZERS names another folder."""
    folder = os.environ.get("FRESHET_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op10_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document with the byte-level vocabulary."""
    path = tokenizer_file("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = heap_bpe.round_trip(docs, path, decoded="text")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = golay.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as grammar-compressed shards and read back from the files."""
    path = scratch_folder(spark, "shards")
    repair.write(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), path)
    return repair.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


@query
def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wu_manber.search(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", wu_manber.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), wu_manber.contaminated().alias("contaminated"),
    )


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are copies or near copies of earlier ones."""
    docs = table(spark, sf_dir, "documents")
    lines = lambda c: F.size(F.filter(F.split(c, "\n", -1), lambda x: F.trim(x, F.lit(fuzzy_lines.WHITE)) != ""))
    both = docs.select("doc_id", "text", lines("text").cast("long").alias("n_lines"))
    slim = fuzzy_lines.deduplicate(both)
    return slim.select("doc_id", "text", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest(lines("text"), F.lit(0)).cast("long").alias("n_kept"))


@query
def op4_mixture_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document, learned from the labelled documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_share(F.col("doc_id"), 4) == 2, F.lit(False))  # rows without an id are not held out
    model = mixture_lang.train(docs.where(~held_out))
    found = mixture_lang.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "langs", "proportions")


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query
def op1_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lm.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring conversations as preference records; masks as ``start-end`` ranges."""
    turns = table(spark, sf_dir, "conversations")
    records = preference.format_pairs(turns, preference.neighbour_pairs(turns))
    ranges = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return records.withColumns({"chosen_mask": ranges("chosen_mask"), "rejected_mask": ranges("rejected_mask")})


SQL["op2_preference_pairs"] = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
m AS (SELECT pair_id, turn, role, text, sum(1 - side) AS n0, sum(side) AS n1 FROM t GROUP BY ALL),
c AS (SELECT pair_id, min(CASE WHEN n0 <> n1 THEN turn END) AS cut, max(n0) AS any0, max(n1) AS any1 FROM m GROUP BY 1),
s AS (
  SELECT t.*, c.any0, c.any1, CASE WHEN cut IS NULL OR turn < cut THEN 'p' WHEN side = 0 THEN 'c' ELSE 'r' END AS part,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM t JOIN c USING (pair_id)
),
o AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, part, side ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM s
),
f AS (
  SELECT *, (stop - length(shown) + 13 + length(role))::VARCHAR || '-' || (stop - 1)::VARCHAR AS span FROM o
)
SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id,
  count(*) FILTER (part = 'p' AND side = 0) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'p' AND side = 0), '') AS prompt,
  CASE WHEN max(any0) > 0 THEN coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'c'), '') END AS chosen,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (part = 'c' AND role = 'assistant'), '') AS chosen_mask,
  CASE WHEN max(any1) > 0 THEN coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'r'), '') END AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (part = 'r' AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (part <> 'p') = 0 AS tied
FROM f GROUP BY pair_id
"""


@query
def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out third."""
    held_out = F.coalesce(crc_share(F.col("doc_id"), 3) == 1, F.lit(False))  # rows without an id are not held out
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(~held_out)
    return rule_ensemble.judge(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op3_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one, among all others."""
    pts = stash(pruned_graph.points(table(spark, sf_dir, "embeddings")), "vectors")
    graph = stash(pruned_graph.index(pts), "graph")
    return pruned_graph.search(graph, pts.where("vec_id % 100 = 0"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query
def op12_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five exact rounds."""
    return bit_planes.described(*bit_planes.cluster(table(spark, sf_dir, "embeddings")))


def _rounds(n: int) -> str:
    """SQL of n rounds: distances, assignment, centroids."""
    steps = []
    for r in range(n + 1):
        steps.append(
            f"d{r} AS (SELECT r, c, sum((v.x - t.x) * (v.x - t.x)) AS d FROM v JOIN c{r} t USING (i) GROUP BY r, c), "
            f"a{r} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY r)"
        )
        if r < n:
            steps.append(
                f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (r) GROUP BY c, i), "
                f"c{r + 1} AS (SELECT t.c, t.i, coalesce((s - ((s % n) + n) % n) // n, t.x) AS x FROM c{r} t LEFT JOIN s{r} USING (c, i))"
            )
    return ", ".join(steps)


SQL["op12_bit_plane_clusters"] = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
v AS (SELECT r, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x FROM k),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST) - 1 AS c FROM k QUALIFY c < 40),
c0 AS (SELECT c, i, x FROM f JOIN v USING (r)),
{_rounds(5)},
m AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN k USING (r) JOIN m USING (c)
"""


@query
def op13_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every vector."""
    return pca_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op13_pca_tiles"] = """
WITH RECURSIVE k AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND coalesce(len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good
  FROM embeddings
),
e AS (SELECT a.r AS a, b.r AS b FROM k a JOIN k b ON a.label = b.label AND a.good AND b.good AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(r, o) AS (SELECT r, r FROM k UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.o = e.a),
low AS (SELECT reach.r, min(k.vec_id) AS component_id FROM reach JOIN k ON reach.o = k.r GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM k JOIN low USING (r) LEFT JOIN n USING (r)
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
