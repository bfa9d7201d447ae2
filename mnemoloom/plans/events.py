"""Event log, usage and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.operators import log, usage
from mnemoloom.plans.base import query
from mnemoloom.plans.relational import _FEEDBACK, feedback_claims

C, L = F.col, F.lit

_ACTIVE = "(run_id IS NULL OR run_id NOT IN (SELECT run_id FROM {runs} WHERE status = 'rolled_back'))"


@query("sc05_append_seq", "SELECT (SELECT max(seq) FROM {log}) + row_number() OVER (ORDER BY doc_id) AS seq, doc_id FROM {labels}")
def _(t):
    return log.append(t("log"), t("labels").select("doc_id"), ["doc_id"]).select("seq", "doc_id")


@query("sc06_events_since", f"SELECT seq, type FROM {{log}} WHERE seq > 2000 AND user_id = 'u1' AND type IN ('DECAYED', 'STRENGTHENED') AND {_ACTIVE}")
def _(t):
    return log.events_since(t("log"), t("runs"), 2000, "u1", ["DECAYED", "STRENGTHENED"]).orderBy("seq").select("seq", "type")


@query("sc07_active_log", f"SELECT seq, user_id, type FROM {{log}} WHERE {_ACTIVE}")
def _(t):
    return log.active(t("log"), t("runs")).select("seq", "user_id", "type")


_TYPED = "SELECT seq, user_id, claim_id, CASE type WHEN 'CANONICALIZED' THEN CASE WHEN seq % 4 = 0 THEN 'SUPPORT' ELSE 'NEW' END WHEN 'DECAYED' THEN 'PRUNED' ELSE type END AS type FROM {log}"


@query("k12_claim_state", f"""WITH e AS ({_TYPED}), gone AS (SELECT user_id, claim_id, max(seq) AS g FROM e WHERE type = 'PRUNED' GROUP BY 1, 2),
    live AS (SELECT e.* FROM e LEFT JOIN gone USING (user_id, claim_id) WHERE type <> 'PRUNED' AND (g IS NULL OR seq > g)),
    born AS (SELECT user_id, claim_id, min(seq) AS b FROM live WHERE type = 'NEW' GROUP BY 1, 2)
    SELECT user_id, claim_id, sum(CASE WHEN seq = b THEN 1.0::DOUBLE WHEN type = 'SUPPORT' THEN 0.5 WHEN type = 'STRENGTHENED' THEN 0.25 ELSE 0 END) AS strength, max(seq) AS last_seq
    FROM live JOIN born USING (user_id, claim_id) WHERE seq >= b GROUP BY 1, 2""")  # fmt: skip
def _(t):
    """Claim state as aggregates of the log: the relational half of a rebuild."""
    kind = F.expr("CASE type WHEN 'CANONICALIZED' THEN CASE WHEN seq % 4 = 0 THEN 'SUPPORT' ELSE 'NEW' END WHEN 'DECAYED' THEN 'PRUNED' ELSE type END")
    return log.claim_state(t("log").select("seq", "user_id", "claim_id", kind.alias("type")))


def concept_log(t):
    """The log with concept payloads: some events create, others attach, merge or prune."""
    payload = F.expr("""CASE seq % 5
        WHEN 0 THEN concat('{"concept_id":"c', seq % 40, '","label":"l', seq % 40, '","claim_ids":["', claim_id, '"]}')
        WHEN 1 THEN concat('{"winner_id":"c', seq % 40 - 1, '","loser_id":"c', (seq + 10) % 40 - 1, '"}')
        WHEN 2 THEN concat('{"concept_id":"c', seq % 40 - 2, '","claim_id":"', claim_id, '"}')
        ELSE concat('{"concept_id":"c', seq % 40 - seq % 5, '","claim_ids":["', claim_id, '"]}') END""")
    kind = F.expr("CASE seq % 5 WHEN 0 THEN 'CONCEPT_CREATED' WHEN 1 THEN CASE WHEN seq % 35 = 1 THEN 'MERGED' ELSE 'ENCODED' END WHEN 2 THEN 'PRUNED' ELSE 'ATTACHED' END")
    return t("log").select("seq", "user_id", F.lit("").alias("ts"), "run_id", kind.alias("type"), payload.alias("payload"))


@query("k12_rebuild_fold")
def _(t):
    """Concept membership folded from the active log."""
    return log.rebuild(concept_log(t), t("runs"))


@query("k13_rollback_rebuild")
def _(t):
    """The same after one more run is rolled back."""
    return log.rebuild(concept_log(t), log.roll_back(t("runs"), "run_3"))


def full_log(t):
    """The log with payloads of all types that materialise something, dealt out by seq."""
    n, c = "cast(seq % 40 as string)", "claim_id"
    kinds = {
        "CANONICALIZED": f"""concat('{{"action":"', if(seq % 3 = 0, 'support', 'new'), '","claim_id":"', {c}, '"}}')""",
        "CONCEPT_CREATED": f"""concat('{{"concept_id":"c', {n}, '","label":"l', {n}, '","claim_ids":["', {c}, '"]}}')""",
        "ATTACHED": f"""concat('{{"concept_id":"c', {n}, '","claim_ids":["', {c}, '"]}}')""",
        "MERGED": f"""concat('{{"winner_id":"c', {n}, '","loser_id":"c', (seq + 7) % 40, '"}}')""",
        "SPLIT": f"""concat('{{"concept_id":"c', {n}, '","into":[{{"concept_id":"c', (seq + 3) % 40, '","claim_ids":["', {c}, '"]}}]}}')""",
        "RELATED": f"""concat('{{"from_id":"', {c}, '","to_id":"clm_', seq % 29, '","relation":"leads_to","weight":', seq % 10 / 10.0, '}}')""",
        "STRENGTHENED": f"""concat('{{"claim_id":"', {c}, '","delta":0.25}}')""",
        "DECAYED": f"""concat('{{"concept_id":"c', {n}, '","state_to":"', if(seq % 2 = 0, 'stale', 'dormant'), '"}}')""",
        "BACKGROUNDED": f"""concat('{{"claim_id":"', {c}, '"}}')""",
        "UNBACKGROUNDED": f"""concat('{{"claim_id":"', {c}, '"}}')""",
        "PRUNED": f"""concat('{{"concept_id":"c', {n}, '","claim_id":"', {c}, '"}}')""",
        "VERSIONED": f"""concat('{{"version_group":"v', {n}, '","mode":"supersede","current_id":"', {c}, '","other_id":"clm_', seq % 31, '"}}')""",
        "CHANNEL_REDUNDANCY": f"""concat('{{"pairs":{{"', {c}, '":["c', {n}, '"]}}}}')""",
        "QUERY_INJECTED": f"""concat('{{"queries":[{{"id":"qclm_', {n}, '","text":"t","concept_ids":["c', {n}, '"]}}]}}')""",
        "FRAGMENTED": f"""concat('{{"fragments":[{{"frag_id":"f', seq % 300, '","cluster":"c', {n}, '"}}],"reinforced":["f', seq % 37, '"]}}')""",
        "RECLUSTERED": f"""concat('{{"assignments":{{"f', seq % 300, '":"c', {n}, '"}}}}')""",
        "ENCODED": "'{}'",
    }
    which = F.pmod(F.col("seq") * 11 + F.floor(F.col("seq") / 17), L(len(kinds)))
    kind, payload = F, F
    for i, (k, e) in enumerate(kinds.items()):
        kind, payload = kind.when(which == i, k), payload.when(which == i, F.expr(e))
    return t("log").select("seq", "user_id", F.lit("").alias("ts"), "run_id", kind.alias("type"), payload.alias("payload"))


@query("k11_replay_all")
def _(t):
    """Concepts, members, claims, relations, fragments and query-claims folded from the active log of all event types."""
    return log.rebuild_all(full_log(t), t("runs"))


@query("k11_relation_state", f"""SELECT user_id, claim_id AS from_id, concat('clm_', seq_ % 29) AS to_id, 'leads_to' AS relation, max_by(seq % 10 / 10.0::DOUBLE, seq) AS weight
    FROM (SELECT *, seq AS seq_ FROM {{log}} WHERE type = 'STRENGTHENED' AND {_ACTIVE}) GROUP BY 1, 2, 3, 4""")  # fmt: skip
def _(t):
    """Relations as aggregates of the log: a repeated one changes its weight alone."""
    e = log.active(t("log"), t("runs")).where("type = 'STRENGTHENED'")
    to, weight = F.concat(L("clm_"), C("seq") % 29), (C("seq") % 10 / 10.0).cast("double")
    return log.relation_state(e.select("seq", "user_id", C("claim_id").alias("from_id"), to.alias("to_id"), L("leads_to").alias("relation"), weight.alias("weight")))


@query("k11_flag_state", f"""SELECT user_id, claim_id, max_by(CASE WHEN type = 'DECAYED' THEN 1 ELSE 0 END, seq) AS background FROM {{log}} WHERE type IN ('DECAYED', 'STRENGTHENED') AND {_ACTIVE} GROUP BY 1, 2""")
def _(t):
    e = log.active(t("log"), t("runs"))
    kind = F.when(C("type") == "DECAYED", "BACKGROUNDED").when(C("type") == "STRENGTHENED", "UNBACKGROUNDED")
    return log.flag_state(e.select("seq", "user_id", "claim_id", kind.alias("type")))


@query("a04_exposure_demote", f"""WITH shown AS (SELECT user_id, episode_id, count(*) AS seen, sum(fetched) AS fetched FROM {{signals}} GROUP BY 1, 2),
    e AS (SELECT s.user_id, s.claim_id, sum(seen) AS seen, sum(fetched) AS f FROM {{support}} s JOIN shown USING (user_id, episode_id) GROUP BY 1, 2),
    v AS (SELECT user_id, claim_id, sum(vote) AS net FROM ({_FEEDBACK}) GROUP BY 1, 2)
    SELECT e.user_id, e.claim_id, cast(e.seen AS BIGINT) AS seen FROM e LEFT JOIN v USING (user_id, claim_id) WHERE e.seen >= 3 AND e.f = 0 AND coalesce(net, 0) <= 0""")  # fmt: skip
def _(t):
    return usage.exposed_never_fetched(t("signals"), t("support"), feedback_claims(t))


@query("a05_net_votes", f"SELECT user_id, claim_id, cast(sum(vote) AS BIGINT) AS net FROM ({_FEEDBACK}) GROUP BY 1, 2")
def _(t):
    return usage.net_votes(feedback_claims(t))


@query("a06_feedback_changes", f"""SELECT user_id, claim_id, CASE WHEN net > 0 THEN 'UNBACKGROUNDED' ELSE 'BACKGROUNDED' END AS type FROM
    (SELECT user_id, claim_id, sum(vote) AS net FROM ({_FEEDBACK}) GROUP BY 1, 2) v JOIN {{claims}} c USING (user_id, claim_id)
    WHERE (net > 0 AND background = 1) OR (net <= -1 AND background = 0)""")  # fmt: skip
def _(t):
    return usage.feedback_changes(feedback_claims(t), t("claims"))


@query("a07_recurrent", """SELECT c.claim_id, n FROM {claims} c JOIN (SELECT claim_id, count(DISTINCT episode_id) AS n FROM {support} GROUP BY 1) s USING (claim_id)
    WHERE n - 1 >= 2 AND background = 0 AND claim_id IN (SELECT claim_id FROM {members} WHERE kind = 'primary')""")  # fmt: skip
def _(t):
    return usage.recurrent(t("support"), t("claims"), t("members"))


@query("a08_strengthened_top3", """SELECT claim_id, n FROM (SELECT claim_id, count(*) AS n, min(seq) AS f FROM {log} WHERE type IN ('STRENGTHENED', 'CANONICALIZED') GROUP BY 1 ORDER BY n DESC, f LIMIT 3)""")
def _(t):
    return usage.strengthened(t("log"))


@query("k07_echo_strengthen", "SELECT l.claim_id, count(*) * 0.25::DOUBLE AS delta FROM {log} l WHERE type = 'STRENGTHENED' AND claim_id IN (SELECT claim_id FROM {claims}) GROUP BY 1")
def _(t):
    """Echoes of a receipt strengthen the claims that exist."""
    e = t("log").where("type = 'STRENGTHENED'").join(t("claims").select("claim_id"), "claim_id", "left_semi")
    return e.groupBy("claim_id").agg((F.count(L(1)) * 0.25).cast("double").alias("delta"))


@query("k16_latest_blueprint", f"SELECT claim_id, max_by(props, seq) AS props FROM {{log}} WHERE type = 'CANONICALIZED' AND {_ACTIVE} GROUP BY 1")
def _(t):
    return log.active(t("log"), t("runs")).where("type = 'CANONICALIZED'").groupBy("claim_id").agg(F.max_by("props", "seq").alias("props"))


@query("h02_flags_and_tombstones", "SELECT claim_id, max_by(CASE WHEN type = 'DECAYED' THEN 1 ELSE 0 END, seq) AS background FROM {log} WHERE type IN ('DECAYED', 'CANONICALIZED') GROUP BY 1")
def _(t):
    e = t("log").where(C("type").isin("DECAYED", "CANONICALIZED"))
    return e.groupBy("claim_id").agg(F.max_by(F.when(C("type") == "DECAYED", 1).otherwise(0), "seq").alias("background"))


@query("d07_dangling", """SELECT from_id, to_id, relation FROM {relations} WHERE from_id NOT IN (SELECT claim_id FROM {claims} UNION SELECT concept_id FROM {concepts})
    OR to_id NOT IN (SELECT claim_id FROM {claims} UNION SELECT concept_id FROM {concepts})""")  # fmt: skip
def _(t):
    nodes = t("claims").select(C("claim_id").alias("id")).unionByName(t("concepts").select(C("concept_id").alias("id")))
    return log.dangling(t("relations"), nodes).select("from_id", "to_id", "relation")


@query("b13_digest", f"""WITH e AS (SELECT seq, type, claim_id FROM {{log}} WHERE seq > 9000 AND {_ACTIVE}), lines AS (SELECT seq, CASE type WHEN 'STRENGTHENED' THEN concat('stronger: ', claim_id)
    WHEN 'DECAYED' THEN concat('fading: ', claim_id) WHEN 'CANONICALIZED' THEN concat('claim: ', claim_id) END AS line FROM e)
    SELECT line, min(seq) AS pos FROM lines WHERE line IS NOT NULL GROUP BY line""")  # fmt: skip
def _(t):
    """Lines of what changed since a point of the log, each once, in order of first mention."""
    e = log.events_since(t("log"), t("runs"), 9000)
    line = F.when(C("type") == "STRENGTHENED", F.concat(L("stronger: "), "claim_id")).when(C("type") == "DECAYED", F.concat(L("fading: "), "claim_id"))
    line = line.when(C("type") == "CANONICALIZED", F.concat(L("claim: "), "claim_id"))
    return e.select("seq", line.alias("line")).where("line is not null").groupBy("line").agg(F.min("seq").alias("pos"))


@query("st04_recency_windows", """SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM {log} GROUP BY 1, 2""")
def _(t):
    return t("log").groupBy("user_id", F.window(C("ts").cast("timestamp_ntz"), "1 hour")["start"].alias("hour")).agg(F.count(L(1)).alias("n"))
