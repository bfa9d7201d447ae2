"""Query over all pages: write archives, read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.llm import warc
from mnemoloom.session import table


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}

#: Five bits at a time of the digest's 160, by the place of each group.
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + cast(list_sum(list_transform(range(0, 5), lambda j: cast(substr(bits, 1 + i * 5 + j, 1) AS INTEGER) << (4 - j))) AS INTEGER), 1)), '')"
)
ORACLE_SQL = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d,
    array_to_string(list_transform(range(1, 41), lambda i: CASE upper(substr(sha1(b), i, 1))
      WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101'
      WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'A' THEN '1010' WHEN 'B' THEN '1011'
      WHEN 'C' THEN '1100' WHEN 'D' THEN '1101' WHEN 'E' THEN '1110' ELSE '1111' END), '') AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first_id FROM h)
SELECT page_id, cast(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""",
}
