"""Query over all documents: fingerprints of texts and edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.llm import fingerprint
from mnemoloom.session import table


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op5_document_fingerprints": op5_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
