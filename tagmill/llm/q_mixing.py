"""Query and SQL of mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import mixing
from tagmill.llm.common import table

#: Sampling weights of documents labelled good, labelled bad and not labelled.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and sampling weight of the labelled documents."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return labels.select("doc_id", F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, BAD).otherwise(UNKNOWN).alias("quality"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, quality=quality_weights(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '/8'), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0)
           / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS k
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), f AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER w, 0) * 3 AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight,
         source_size::DOUBLE / weight AS ratio
  FROM s WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - used)::DOUBLE / open_weight AS own FROM f
), m AS (
  SELECT *, (SELECT arg_min(own, ratio) FROM l WHERE own * weight <= 3 * source_size) AS level FROM l
), t AS (
  SELECT source, source_size, least(3.0 * source_size::DOUBLE, coalesce(level * weight, 3.0 * source_size::DOUBLE)) AS target FROM m
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), p AS (
  SELECT doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(least(size, rest - before), 0))::BIGINT AS taken FROM p
"""
QUERIES = {"op8_mixing_sources": op8_mixing_sources}
ORACLE_SQL = {"op8_mixing_sources": SQL}
