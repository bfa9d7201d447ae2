"""Query over all documents: the features of every whole text and the cascade's verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.llm import quality
from mnemoloom.session import table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op7_quality_rules": op7_quality_rules}

_WS = "[\\x20\\x09-\\x0D]"
_FEATURES = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT doc_id, rid, t, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS ws FROM docs),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM win),
hit AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM hit WHERE n > 1) GROUP BY rid),
f AS (
  SELECT doc_id, rid, len(ws) AS n_words,
    cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    cast(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_WS}+', '', 'g') <> '') AS ln
  FROM w
), g AS (
  SELECT f.doc_id, cast(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_upper,
    cast(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, cast(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM f LEFT JOIN covered c ON c.rid = f.rid
)
"""
ORACLE_SQL = {
    "op7_quality_rules": f"""
WITH {_FEATURES}, b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 3 * word_chars OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR (n_dup_lines >= 10 AND 20 * n_dup_lines > n_words)) AS kept
FROM b
""",
}
