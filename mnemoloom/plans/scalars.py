"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.functions import health, ids, text
from mnemoloom.plans.base import query

C, L = F.col, F.lit


@query("pf04_prefix_filter", "SELECT claim_id FROM {support} WHERE NOT starts_with(claim_id, 'qclm_') AND starts_with(claim_id, 'clm_1')")
def _(t):
    return t("support").where(~F.startswith("claim_id", L("qclm_")) & F.startswith("claim_id", L("clm_1"))).select("claim_id")


@query("pf05_timeline", """SELECT seq, type, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {log} WHERE contains(props, '"k": 1') ORDER BY seq LIMIT 40""")
def _(t):
    """Events that mention an id: substring first, then the typed projection."""
    e = t("log").where(F.contains("props", L('"k": 1'))).orderBy("seq").limit(40)
    return e.select("seq", "type", F.from_json("props", "k long")["k"].alias("k"))


@query("pf06_json_path", "SELECT seq, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {log} WHERE type = 'CANONICALIZED'")
def _(t):
    return t("log").where("type = 'CANONICALIZED'").select("seq", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("pf07_essence", """SELECT episode_id, coalesce(nullif(CASE WHEN ts % 2 = 0 THEN title ELSE '' END, ''), replace(substring(raw_text, 1, 120), chr(10), ' ')) AS essence FROM {episodes}""")
def _(t):
    return t("episodes").select("episode_id", text.essence(F.when(C("ts") % 2 == 0, C("title")).otherwise(""), C("raw_text")).alias("essence"))


@query("pf08_l2_cosine", """SELECT a.vec_id AS a, round(1 - power(list_distance(cast(a.embedding AS DOUBLE[]), cast(b.embedding AS DOUBLE[])), 2) / 2, 4) AS sim
    FROM {claims} a JOIN {claims} b ON b.vec_id = a.vec_id + 4""")  # fmt: skip
def _(t):
    """Cosine of unit vectors from their squared distance."""
    a = t("claims").select(C("vec_id").alias("a"), C("embedding").alias("x"))
    b = t("claims").select((C("vec_id") - 4).alias("a"), C("embedding").alias("y"))
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), L(0.0), lambda s, v: s + v)
    return a.join(b, "a").select("a", F.round(1 - square / 2, 4).alias("sim"))


@query("pf09_content_ids", """SELECT claim_id, concat('clm_', md5(concat(user_id, chr(0), lower(trim(text))))) AS id,
    concat('frg_', substring(md5(concat(user_id, chr(0), claim_id, chr(0), vec_id, '-', vec_id + 1)), 1, 24)) AS frag FROM {claims}""")  # fmt: skip
def _(t):
    return t("claims").select(
        "claim_id", ids.claim_id(C("user_id"), C("text")).alias("id"), ids.fragment_id(C("user_id"), C("claim_id"), C("vec_id"), C("vec_id") + 1).alias("frag")
    )


@query("pf10_ulid")
def _(t):
    """Time-ordered ids that a rerun reproduces."""
    return t("log").select("seq", ids.ulid(C("seq") * 1000, C("seq"), "ep_").alias("id"))


@query("pf11_days_since", """SELECT claim_id, CASE WHEN vec_id % 10 = 3 THEN 999 ELSE cast(floor(((epoch(TIMESTAMP '2024-06-30 12:00:00') - epoch(TIMESTAMP '2024-01-01 00:00:00')) - vec_id * 3600) / 86400) AS BIGINT) END AS days FROM {claims}""")
def _(t):
    """``now`` is a parameter; unreadable times count 999 days."""
    iso = F.date_format(F.timestamp_seconds(L(1704067200) + C("vec_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    ts = F.when(C("vec_id") % 10 == 3, L("not a time")).otherwise(iso)
    return t("claims").select("claim_id", health.days_since(ts, "2024-06-30 12:00:00").alias("days"))


@query("pf12_sentences")
def _(t):
    """Sentences of every episode with their places; look-behind keeps this out of DuckDB's dialect."""
    e = t("episodes").select("episode_id", "user_id", F.posexplode(text.sentences(C("raw_text"))).alias("idx", "sentence"))
    return e.select("episode_id", "user_id", C("idx").cast("long").alias("idx"), "sentence")


@query("pf13_clauses", """SELECT conv_id, turn, unnest(CASE WHEN len(k) >= 2 THEN k ELSE [] END) AS clause FROM (SELECT conv_id, turn,
    list_filter(string_split_regex(text, '(?i)\\s*(?:,|;|\\band\\b|\\bor\\b|\\bvs\\b|\\bversus\\b|\\bacross\\b|\\bbetween\\b|\\babout\\b|\\bregarding\\b)\\s*'),
    lambda c: (length(c) >= 4 AND contains(c, ' ')) OR length(c) >= 8) AS k FROM {conversations} WHERE role = 'user')""")  # fmt: skip
def _(t):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", F.explode(text.clauses(C("text"))).alias("clause"))


@query("pf14_chunks", """SELECT conv_id, turn, unnest(list_concat(s, list_transform(range(1, len(s)), lambda i: concat(s[i], ' ', s[i + 1])))) AS chunk
    FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM {conversations})""")  # fmt: skip
def _(t):
    return t("conversations").select("conv_id", "turn", F.explode(text.windows_of_two(F.split("text", "\n", -1))).alias("chunk"))


@query("pf15_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM {documents}")
def _(t):
    return t("documents").select("doc_id", text.token_estimate(C("text")).alias("tokens"))


@query("pf16_word_tokens", "SELECT doc_id, cast(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n FROM {documents}")
def _(t):
    return t("documents").select("doc_id", F.size(text.words(C("text"))).cast("long").alias("n"))


@query("pf17_rounding", "SELECT frag_id, round(residual, 4) AS residual, round(z, 3) AS z FROM {fragments}")
def _(t):
    return t("fragments").select("frag_id", F.round("residual", 4).alias("residual"), F.round("z", 3).alias("z"))


@query("pf18_calibration", """SELECT concept_id, CASE state WHEN 'stale' THEN -2.0::DOUBLE WHEN 'dormant' THEN -3.0::DOUBLE ELSE -3.5::DOUBLE END AS z_echo FROM {concepts}""")
def _(t):
    """Scope's value, else the profile's, else the default."""
    scoped = F.create_map(L("stale"), F.create_map(L("z_echo"), L(-2.0)), L("dormant"), F.create_map(L("z_echo"), L(-3.0)))
    whole = F.create_map(L("prox_margin"), L(1.0))
    return t("concepts").select("concept_id", health.calibrated(scoped, whole, "z_echo", C("state"), -3.5).alias("z_echo"))


@query("pf19_overlay", """SELECT concept_id, 0.35::DOUBLE AS gain, CASE WHEN n % 2 = 0 THEN n::DOUBLE ELSE 6.0::DOUBLE END AS max_items FROM {concepts}""")
def _(t):
    """Saved settings win, nulls don't."""
    saved = F.create_map(L("max_items"), F.when(C("n") % 2 == 0, C("n").cast("double")), L("gain"), L(None).cast("double"))
    m = health.overlay(F.create_map(L("gain"), L(0.35), L("max_items"), L(6.0)), saved)
    return t("concepts").select("concept_id", m["gain"].alias("gain"), m["max_items"].alias("max_items"))


@query("pf20_relation_label", "SELECT from_id, to_id, coalesce(nullif(replace(lower(trim(concat(' ', replace(relation, '_', ' '), ' '))), ' ', '_'), ''), 'leads_to') AS label FROM {relations}")
def _(t):
    raw = F.concat(L(" "), F.replace("relation", L("_"), L(" ")), L(" "))
    return t("relations").select("from_id", "to_id", text.normal_label(raw).alias("label"))


@query("pf21_health_multiplier", "SELECT concept_id, CASE state WHEN 'grounded' THEN 1.3::DOUBLE WHEN 'active' THEN 1.0 WHEN 'stale' THEN 0.4 WHEN 'dormant' THEN 0.2 ELSE 1.0 END AS w FROM {concepts}")
def _(t):
    return t("concepts").select("concept_id", health.health_multiplier(C("state")).alias("w"))


@query("pf22_json_parse", """SELECT seq, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {log}""")
def _(t):
    """Objects wrapped in prose or code fences."""
    reply = F.concat(L("Sure:\n```json\n"), C("props"), L("\n``` done"))
    return t("log").select("seq", F.from_json(text.first_json_object(reply), "k long")["k"].alias("k"))


@query("pf23_cost", "SELECT doc_id, round((n_chars // 4 * 3.0 + 500 * 15.0) / 1e6 * 0.5, 8) AS usd FROM {documents}")
def _(t):
    usd = health.cost(F.floor(C("n_chars") / 4), L(500), 3.0, 15.0, batch=True)
    return t("documents").select("doc_id", F.round(usd, 8).alias("usd"))


@query("k06_decay_state", "SELECT claim_id, CASE WHEN days_inactive <= 30 THEN 'active' WHEN days_inactive <= 60 THEN 'stale' ELSE 'dormant' END AS state FROM {claims}")
def _(t):
    return t("claims").select("claim_id", health.decay_state(C("days_inactive")).alias("state"))
