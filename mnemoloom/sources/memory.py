"""The memory model's tables, derived from the flat test tables by SQL that Spark and DuckDB both read.

``{name}`` stands for a base table or another derived one. A deployment replaces these views by its own tables of the same
columns; operators see DataFrames alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from mnemoloom.session import table

BASE = ("documents", "embeddings", "events", "benchmark", "conversations", "labels", "orders", "customer", "lineitem", "nation", "part", "supplier")

DERIVED = {
    "claims": """SELECT vec_id, concat('clm_', vec_id) AS claim_id, concat('u', vec_id % 4) AS user_id,
        concat('cpt_', vec_id % 4, '_', label) AS concept_id, 1e0 + (vec_id % 7) * 0.5e0 AS strength,
        CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS background, vec_id % 90 AS days_inactive,
        CASE WHEN vec_id % 9 = 0 THEN concat('vg_', vec_id % 4, '_', vec_id % 27) END AS version_group,
        concat('claim text ', vec_id % 50) AS text, embedding FROM {embeddings}""",
    "concepts": """SELECT DISTINCT concat('cpt_', vec_id % 4, '_', label) AS concept_id, concat('u', vec_id % 4) AS user_id,
        concat('topic ', label) AS label, CASE label % 4 WHEN 0 THEN 'grounded' WHEN 1 THEN 'active' WHEN 2 THEN 'stale' ELSE 'dormant' END AS state,
        label AS n FROM {embeddings}""",
    "members": """SELECT concept_id, claim_id, user_id, 'primary' AS kind FROM {claims}
        UNION ALL SELECT concat('cpt_', vec_id % 4, '_', vec_id % 10), claim_id, user_id, 'redundant' FROM {claims} WHERE vec_id % 6 = 0""",
    "support": """SELECT claim_id, user_id, concat('ep_', (vec_id * 7) % 200) AS episode_id, concat('s', vec_id) AS verbatim FROM {claims}
        UNION ALL SELECT claim_id, user_id, concat('ep_', (vec_id * 7 + 13) % 200), concat('s', vec_id, 'b') FROM {claims} WHERE vec_id % 3 >= 1
        UNION ALL SELECT claim_id, user_id, concat('ep_', (vec_id * 7 + 26) % 200), concat('s', vec_id, 'c') FROM {claims} WHERE vec_id % 3 >= 2""",
    "episodes": """SELECT concat('ep_', doc_id) AS episode_id, concat('u', doc_id % 4) AS user_id, doc_id AS ts,
        concat(lang, ' note ', doc_id) AS title, source, text AS raw_text FROM {documents}""",
    "fragments": """SELECT concat('frg_', vec_id) AS frag_id, concat('u', vec_id % 4) AS user_id, concat('ep_', vec_id % 200) AS episode_id,
        vec_id % 7 AS sent_start, vec_id % 7 + vec_id % 3 AS sent_end, CASE WHEN vec_id % 10 = 9 THEN NULL ELSE vec_id % 7 END AS medoid_idx,
        concat('cpt_', vec_id % 4, '_', label) AS cluster, (vec_id % 19) / 19e0 AS residual, (vec_id % 23) / 4e0 - 4e0 AS z,
        CASE WHEN vec_id % 5 > 0 THEN concat('frg_', vec_id - vec_id % 5) END AS anchor_id,
        concat('span ', vec_id) AS text, vec_id, embedding FROM {embeddings}""",
    "relations": """SELECT concat('clm_', vec_id) AS from_id, concat('clm_', vec_id + 4 * (vec_id % 5 + 1)) AS to_id, concat('u', vec_id % 4) AS user_id,
        CASE vec_id % 3 WHEN 0 THEN 'leads_to' WHEN 1 THEN 'contradicts' ELSE 'supports' END AS relation, (vec_id % 11) / 10e0 AS weight, vec_id AS seq FROM {embeddings}
        UNION ALL SELECT c.concept_id, d.concept_id, c.user_id, 'leads_to', (c.n + 1) / 8e0, 100000 + c.n FROM {concepts} c
        JOIN {concepts} d ON c.user_id = d.user_id AND d.n = (c.n + 3) % 10""",
    "log": """SELECT event_id AS seq, ts, concat('u', user_id % 4) AS user_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('run_', event_id % 23) END AS run_id,
        CASE event_type WHEN 'signup' THEN 'CONCEPT_CREATED' WHEN 'error' THEN 'DECAYED' WHEN 'click' THEN 'STRENGTHENED' WHEN 'view' THEN 'RETRIEVAL_SIGNAL' ELSE 'CANONICALIZED' END AS type,
        concat('clm_', event_id % 300) AS claim_id, value, props FROM {events}""",
    "runs": """SELECT DISTINCT concat('run_', event_id % 23) AS run_id, CASE WHEN event_id % 23 % 5 = 0 THEN 'rolled_back' ELSE 'done' END AS status,
        event_id % 23 AS started FROM {events}""",
    "feedback": """SELECT doc_id AS seq, concat('u', doc_id % 4) AS user_id, CASE doc_id % 3 WHEN 0 THEN concat('clm_', doc_id % 300)
        WHEN 1 THEN concat('cpt_', doc_id % 4, '_', doc_id % 10) ELSE concat('ep_', doc_id % 200) END AS node_id,
        CASE WHEN quality = 1 THEN 1 ELSE -1 END AS vote FROM {labels}""",
    "signals": """SELECT seq, user_id, concat('ep_', seq % 200) AS episode_id, CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS fetched FROM {log} WHERE type = 'RETRIEVAL_SIGNAL'""",
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", DERIVED[name])))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``, base or derived."""
    if name not in DERIVED:
        return table(spark, sf_dir, name)
    return spark.sql(DERIVED[name], **{n: load(spark, sf_dir, n) for n in _needs(name)})


def sql(query: str) -> str:
    """DuckDB SQL for ``query``, whose ``{name}`` may be base or derived: derived ones become common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in order:
            for n in _needs(name):
                visit(n)
            order.append(name)

    names = list(dict.fromkeys(re.findall(r"\{(\w+)\}", query)))
    for n in names:
        visit(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    parts = ", ".join(f"{n} AS ({plain(DERIVED[n])})" for n in order)
    body = plain(query).strip()
    if not parts:
        return body
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"
