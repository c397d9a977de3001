"""From documents to packed token files, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the
cluster's shared folder and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import decontaminate, filters, language, mixing, signature_tree
from tagmill.llm.common import discard, release_executors, settle, shared_folder, table
from tagmill.llm.q_mixing import quality_weights
from tagmill.llm.q_token_files import write_and_read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, row by row: ids may be null or repeated."""
    release_executors(spark)
    model = language.train(language.training_texts(docs))
    name = filters.free_name("row_", docs)
    known = language.identify_documents(docs.withColumn(name, filters.row_key(docs)), model, carry=[name])
    rejected = settle(known.where("not kept").select(name))
    return filters.without_rows(docs, rejected)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest id (null ids last), then by row hash.

    Rows alike are one document; other rows with a null or repeated id are their own.
    """
    release_executors(spark)
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        groups = signature_tree.join(docs.select("doc_id", "text"))
        return filters.without(docs, settle(groups.where("component_id <> doc_id").select("doc_id")))
    rows = docs.select(filters.row_key(docs).alias("row_"), "doc_id", "text").withColumn("s", F.xxhash64("row_"))
    groups = signature_tree.join(rows.select(F.col("s").alias("doc_id"), "text")).select(F.col("doc_id").alias("s"), "component_id").distinct()
    linked = settle(groups.where("component_id is not null").join(rows.select("s", "row_", "doc_id").distinct(), "s"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "s")
    least = linked.groupBy("component_id").agg(F.min(order).alias("least"))
    copies = settle(linked.join(least, "component_id").where(F.col("s") != F.col("least.s")).select("row_"))
    return filters.without_rows(docs, copies, once=True)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    release_executors(spark)
    clean = decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as mixed, rows repeated for repeated epochs."""
    release_executors(spark)
    return mixing.apply_mix(docs, quality=quality_weights(spark, sf_dir))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written and read back: doc_id, start, n_tokens, ids_crc32."""
    release_executors(spark)
    return write_and_read(spark, docs.select("doc_id", "text"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]
#: Language scores, tree joins and tokenizing are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
