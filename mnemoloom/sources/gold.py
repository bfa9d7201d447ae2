"""Gold questions as JSON lines: comments and blank lines are skipped, required fields checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Rows of ``lines`` (value) by ``schema``; lines without a required field are dropped."""
    kept = lines.where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    rows = kept.select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.dropna(subset=required)


def read(spark: SparkSession, path: str, schema: str = "id string, query string, key_facts array<string>, hard boolean", required: tuple[str, ...] = ("query", "key_facts")) -> DataFrame:
    return parse(spark.read.text(path), schema, list(required))
