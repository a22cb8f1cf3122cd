"""One query an operator, over its whole table, and the SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import bilinear_lm, byte_bpe, collocations, exact_copies, kernel_quality, mixing, norm_topk, periodic_runs, pii_bootstrap, pruned_graph, simhash_pivots, token_rollup, wrapper_html
from pairloom.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def op2_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.search(table(spark, sf_dir, "embeddings"))


def op3_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_graph.nearest(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, ids=False, decoded=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear_lm.score(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.find(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.query(table(spark, sf_dir, "documents"))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.classes(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_norm_topk, op3_pruned_graph, op4_mixing, op5_token_rollup, op6_byte_bpe, op7_quality, op8_html, op9_bilinear_lm, op10_pii, op11_runs, op12_exact_copies, op13_collocations)
}

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
ORACLES: dict[str, str] = {"op2_norm_topk": TOP_K_SQL, "op4_mixing": mixing.SQL, "op5_token_rollup": token_rollup.SQL, "op11_runs": periodic_runs.SQL, "op12_exact_copies": exact_copies.SQL, "op13_collocations": collocations.SQL}
