"""Query and SQL of suffix-array deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagmill.llm import suffix_groups
from tagmill.llm.common import table


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT row, doc_id, 100 * k AS base, substr(h, 200 * k + 1, 298) AS piece
  FROM (SELECT row, doc_id, h, unnest(generate_series(0, (len(h) // 2 - 50) // 100)) AS k FROM d WHERE len(h) >= 100)
), w AS (
  SELECT row, doc_id, base + r AS i, substr(piece, 2 * r + 1, 100) AS g
  FROM (SELECT *, unnest(generate_series(0, least(99, len(piece) // 2 - 50))) AS r FROM pieces)
), first AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT row, i FROM w JOIN first USING (g) WHERE least < doc_id),
seq AS (
  SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS p, lead(i) OVER (PARTITION BY row ORDER BY i) AS n FROM hit
), runs AS (
  SELECT row, sum(least(coalesce(n - i, 50), 50))::BIGINT AS n_removed, count(*) FILTER (p IS NULL OR i - p > 50) AS n_spans FROM seq GROUP BY row
), starts AS (
  SELECT row, i AS a, row_number() OVER (PARTITION BY row ORDER BY i) AS k FROM seq WHERE p IS NULL OR i - p > 50
), ends AS (
  SELECT row, i + 50 AS b, row_number() OVER (PARTITION BY row ORDER BY i) AS k FROM seq WHERE n IS NULL OR n - i > 50
), spans AS (SELECT row, k, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY k), 0) AS before FROM starts JOIN ends USING (row, k)),
kept AS (
  SELECT row, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS h FROM spans JOIN d USING (row) GROUP BY row
)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN runs USING (row) LEFT JOIN kept USING (row)
"""
QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLE_SQL = {"op2_suffix_array_dedup": SQL}
