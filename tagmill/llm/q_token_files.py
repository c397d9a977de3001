"""Query of token-id output. Tokenizing is not SQL, so tests hold it against whole-text encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagmill.llm import token_files
from tagmill.llm.common import table

TOKENIZER, VOCABULARY = "word_bpe_49k.json", 49_408


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def write_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write(docs, folder, tokenizer_path(), vocabulary=VOCABULARY)
    return token_files.read(spark, folder)


QUERIES = {"op9_token_output": op9_token_output}
ORACLE_SQL: dict[str, str] = {}
