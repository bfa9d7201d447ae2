"""Query over all documents: an empty ledger, so every blob is unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.llm import secrets
from mnemoloom.session import table


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_secret_scans": op3_secret_scans}


def _spans(rule: secrets.Rule, order: int) -> str:
    """SQL for the spans of one rule: gaps between matches and matches add up to places."""
    pattern = rule.pattern.replace("'", "''").replace("\\x20", " ")
    return f"""
  SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, len(m) AS n_hits, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
      s := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
      n := length(m[i]), size := length(v[i])))) AS p
  FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m,
      regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM docs)"""


_ALL = " UNION ALL ".join(_spans(r, i) for i, r in enumerate(secrets.RULES))
_LEAST = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES)
_COUNTS = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secrets.BASE)

ORACLE_SQL = {
    "op3_secret_scans": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({_ALL}),
spans AS (
  SELECT doc_id, o, kind, cast(p.s AS BIGINT) AS s, cast(p.s + p.n AS BIGINT) AS e FROM hits
  WHERE p.size >= CASE kind {_LEAST} END
), per AS (
  SELECT doc_id, {_COUNTS},
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < {len(secrets.BASE)}), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per USING (doc_id)
""",
}
