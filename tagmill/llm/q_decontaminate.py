"""Query and SQL of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagmill.llm import decontaminate
from tagmill.llm.common import table


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.report(decontaminate.scan(docs.select("doc_id", "text"), items.select("item_id", "text")))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT item, ws, least(len(ws), 10) AS size, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS i FROM b WHERE len(ws) > 0)
), positions AS (
  SELECT row, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT row, ws, unnest(generate_series(1, len(ws))) AS i FROM d WHERE len(ws) > 0), (SELECT DISTINCT size FROM windows)
  WHERE i + size - 1 <= len(ws)
), hits AS (SELECT row, i, p.size, item FROM positions p JOIN windows w ON p.size = w.size AND p.gram = w.gram),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""
QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLE_SQL = {"op5_benchmark_decontamination": SQL}
