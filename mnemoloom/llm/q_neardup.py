"""Query over all documents: the near-duplicate class of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.llm import neardup
from mnemoloom.session import table


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


QUERIES = {"op4_minhash_neardup": op4_minhash_neardup}
ORACLE_SQL: dict[str, str] = {}
