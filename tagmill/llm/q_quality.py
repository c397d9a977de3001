"""Query of the quality classifier. Compression is not SQL, so tests use held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import quality
from tagmill.llm.common import table

FOLDS, HELD_OUT, CUT = 4, 2, 0.7


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(*quality.training_rows(docs, table(spark, sf_dir, "labels"), keep=lambda k: ~held_out(k)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
