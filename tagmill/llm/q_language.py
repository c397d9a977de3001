"""Query of language identification, over documents and pages. Not SQL; tests use accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import language
from tagmill.llm.common import table


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document (doc_id) and each page (page_id)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.train(language.training_texts(docs))
    of_docs = language.identify_documents(docs, model, carry=["doc_id"])
    of_pages = language.identify_pages(pages, model, carry=["page_id"])
    return of_docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "lang", "p", "kept").unionByName(of_pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "lang", "p", "kept"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
