"""Query and SQL of exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagmill.llm import topk
from tagmill.llm.common import table

K, EVERY, SCALE = 20, 20, 64


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), scale=SCALE)
    return topk.top_k(vectors, vectors.where(f"vec_id % {EVERY} = 0"), k=K)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
QUERIES = {"op7_exact_topk": op7_exact_topk}
ORACLE_SQL = {"op7_exact_topk": SQL}
