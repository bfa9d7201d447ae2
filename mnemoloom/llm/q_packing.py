"""Query over all documents: tokenize, cut, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.llm import packing
from mnemoloom.llm.q_bpe import vocabulary
from mnemoloom.session import table


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
