"""Query over all pages: the main text of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.llm import html
from mnemoloom.session import table


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
