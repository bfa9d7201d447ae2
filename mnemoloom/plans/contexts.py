"""Budgeted context assembly, browsing and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.operators import budget as B
from mnemoloom.operators import graph
from mnemoloom.operators import predictor as P
from mnemoloom.operators import relational as R
from mnemoloom.plans.base import query
from mnemoloom.plans.graphs import edges, seeds

C, L = F.col, F.lit


@query("b01_budget_cut", """SELECT user_id, frag_id, cast(used AS BIGINT) AS used FROM (SELECT user_id, frag_id, sum(length(text) + 1) OVER (PARTITION BY user_id ORDER BY residual DESC, vec_id) AS used FROM {fragments}) WHERE used <= 400""")
def _(t):
    return B.cut_lines(t("fragments"), ["user_id"], [F.desc("residual"), C("vec_id")], "text", 400).select("user_id", "frag_id", "used")


@query("b02_episode_order", "SELECT frag_id, episode_id, min(vec_id) OVER (PARTITION BY user_id, episode_id) AS block_rank FROM {fragments}")
def _(t):
    return B.by_first_rank(t("fragments"), ["user_id"], "episode_id", "vec_id").select("frag_id", "episode_id", "block_rank")


@query("b03_block_budget", """SELECT user_id, frag_id, cast(used AS BIGINT) AS used FROM (SELECT user_id, frag_id, sum(length(text)) OVER w AS used, row_number() OVER w AS pos FROM {fragments}
    WINDOW w AS (PARTITION BY user_id ORDER BY residual DESC, vec_id)) WHERE used <= 5 OR pos = 1""")  # fmt: skip
def _(t):
    """The first block stays however large it is."""
    return B.cut_blocks(t("fragments"), ["user_id"], [F.desc("residual"), C("vec_id")], "text", L(5)).select("user_id", "frag_id", "used")


@query("b04_depth_breadth", """WITH lay AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'depth' ELSE 'breadth' END AS layer FROM {fragments}),
    w AS (SELECT user_id, frag_id, layer, text, sum(length(text)) OVER w AS used, row_number() OVER w AS pos FROM lay WINDOW w AS (PARTITION BY user_id, layer ORDER BY residual DESC, vec_id)),
    br AS (SELECT * FROM w WHERE layer = 'breadth' AND (used <= 350.0 OR pos = 1)), sp AS (SELECT user_id, sum(length(text)) AS spent FROM br GROUP BY 1)
    SELECT user_id, frag_id, layer FROM br UNION ALL SELECT w.user_id, frag_id, layer FROM w LEFT JOIN sp ON sp.user_id = w.user_id WHERE layer = 'depth' AND (used <= 500 - coalesce(spent, 0) OR pos = 1)""")  # fmt: skip
def _(t):
    f = t("fragments").withColumn("layer", F.when(C("vec_id") % 3 == 0, "depth").otherwise("breadth"))
    return B.depth_and_breadth(f, ["user_id"], [F.desc("residual"), C("vec_id")], "text", 500).select("user_id", "frag_id", "layer")


@query("b05_concept_frame", """SELECT user_id, concept_id FROM (SELECT user_id, concept_id, sum(length(label) + 1) OVER (PARTITION BY user_id ORDER BY n DESC) AS used FROM {concepts}) WHERE used <= 0.35 * 100""")
def _(t):
    """The frame of concepts takes at most 35 % of the characters."""
    return B.cut_lines(t("concepts"), ["user_id"], [F.desc("n")], "label", 35).select("user_id", "concept_id")


@query("b06_blend", """WITH a AS (SELECT user_id, claim_id AS id, text, vec_id AS ord, 'a' AS side FROM {claims} WHERE user_id <> 'u3'), b AS (SELECT user_id, frag_id, text, vec_id, 'b' FROM {fragments} WHERE user_id <> 'u2'),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b), w AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY user_id, side ORDER BY ord) AS used, count(*) FILTER (WHERE side = 'a') OVER (PARTITION BY user_id) AS na,
    count(*) FILTER (WHERE side = 'b') OVER (PARTITION BY user_id) AS nb FROM u)
    SELECT user_id, id, side FROM w WHERE used <= 300 * CASE WHEN side = 'a' THEN CASE WHEN nb > 0 THEN 0.4 ELSE 1 END ELSE CASE WHEN na > 0 THEN 0.6 ELSE 1 END END""")  # fmt: skip
def _(t):
    a = t("claims").where("user_id <> 'u3'").select("user_id", C("claim_id").alias("id"), "text", C("vec_id").alias("ord"))
    b = t("fragments").where("user_id <> 'u2'").select("user_id", C("frag_id").alias("id"), "text", C("vec_id").alias("ord"))
    return B.blend(a, b, ["user_id"], [C("ord")], "text", 300).select("user_id", "id", "side")


def bright(t, n=12):
    e = edges(t)
    s = graph.salience(graph.spread(seeds(t), e), e)
    return R.top_n(s, ["query"], [F.desc(F.round("salience", 9)), C("node")], n)


@query("b07_resonance_recall")
def _(t):
    """Brightest nodes to their episodes' fragments, then greedy choice."""
    nodes = bright(t).select("query", "node", "salience")
    claims = nodes.join(t("support").select(C("claim_id").alias("node"), "episode_id"), "node")
    members = nodes.join(t("members").select(C("concept_id").alias("node"), "claim_id"), "node").join(t("support").select("claim_id", "episode_id"), "claim_id")
    eps = claims.select("query", "episode_id", "salience").unionByName(members.select("query", "episode_id", "salience"))
    best = eps.groupBy("query", "episode_id").agg(F.max("salience").alias("salience"))
    frag = R.top_n(t("fragments").where("medoid_idx is not null"), ["episode_id"], [F.desc("residual"), C("frag_id")], 2)
    cand = frag.join(best, "episode_id").select("query", C("frag_id").alias("id"), "embedding", "salience")
    peak = cand.groupBy("query").agg(F.max("salience").alias("top"))
    q = t("claims").where("vec_id % 40 = 0").select(F.concat(L("q"), F.floor(C("vec_id") / 40)).alias("query"), C("embedding").alias("qvec"))
    ready = cand.join(peak, "query").join(q, "query").withColumn("weight", C("salience") / C("top"))
    return P.assemble(ready.select("query", "id", "embedding", "weight", "qvec"), "query", k=24, gain_floor=0.20)


@query("b08_fragment_recall")
def _(t):
    """The 40 nearest fragments above the triage bound, the query's own aside, then greedy choice by relevance."""
    q = t("claims").where("vec_id % 20 = 0").select("user_id", C("claim_id").alias("id"), "embedding")
    # by the claim's id, so that the search leaves the query's own fragment out
    f = t("fragments").where("medoid_idx is not null").select("user_id", F.concat(L("clm_"), F.substring("frag_id", 5, 99)).alias("id"), "embedding", "cluster")
    found = P.assemble_near(P.neighbours(q, f, 40), 40, k=24, least=0.15)
    return found.withColumn("id", F.concat(L("frg_"), F.substring("id", 5, 99)))


@query("b09_background_concepts")
def _(t):
    """Background frame: at most three concepts near the query, four claims each."""
    from mnemoloom.operators import knn
    from mnemoloom.plans.vectors import unit_means

    q = t("claims").where("vec_id % 20 = 0").select("user_id", C("claim_id").alias("query"), C("embedding").alias("qvec"))
    near = unit_means(t).join(q, "user_id").withColumn("cos", knn.similarity(C("qvec"), C("embedding"))).where("cos >= 0.18")
    top = R.top_n(near, ["query"], [F.desc("cos"), C("concept_id")], 3).select("query", "concept_id", F.round("cos", 4).alias("cos"))
    m = R.top_n(t("claims"), ["concept_id"], [F.desc("strength"), C("claim_id")], 4).select("concept_id", "claim_id")
    return top.join(m, "concept_id")


@query("b10_concept_context", """WITH k AS (SELECT concept_id, claim_id, text, strength, row_number() OVER (PARTITION BY concept_id ORDER BY strength DESC, claim_id) AS rn FROM {claims})
    SELECT concept_id, claim_id, cast(used AS BIGINT) AS used FROM (SELECT concept_id, claim_id, sum(length(text) + 1) OVER (PARTITION BY concept_id ORDER BY rn) AS used FROM k WHERE rn <= 12) WHERE used <= 60""")  # fmt: skip
def _(t):
    k = R.top_n(t("claims"), ["concept_id"], [F.desc("strength"), C("claim_id")], 12)
    return B.cut_lines(k, ["concept_id"], [C("rn")], "text", 60).select("concept_id", "claim_id", "used")


@query("b12_receipt_lines", """SELECT user_id, string_agg(concat('- ', claim_id), chr(10) ORDER BY rn) AS section FROM (SELECT user_id, claim_id, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, claim_id) AS rn FROM {claims}) WHERE rn <= 5 GROUP BY 1""")
def _(t):
    top = R.top_n(t("claims"), ["user_id"], [F.desc("strength"), C("claim_id")], 5)
    g = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rn", "claim_id"))).alias("p"))
    return g.select("user_id", F.array_join(F.transform("p", lambda x: F.concat(L("- "), x["claim_id"])), "\n").alias("section"))


@query("b14_claim_view", """SELECT c.claim_id, c.strength, count(DISTINCT s.episode_id) AS episodes, count(DISTINCT m.concept_id) AS concepts FROM {claims} c LEFT JOIN {support} s ON s.claim_id = c.claim_id
    LEFT JOIN {members} m ON m.claim_id = c.claim_id GROUP BY 1, 2""")  # fmt: skip
def _(t):
    """Nested provenance, each side aggregated before it joins."""
    s = t("support").groupBy("claim_id").agg(F.countDistinct("episode_id").alias("episodes"))
    m = t("members").groupBy("claim_id").agg(F.countDistinct("concept_id").alias("concepts"))
    out = t("claims").select("claim_id", "strength").join(s, "claim_id", "left").join(m, "claim_id", "left")
    return out.select("claim_id", "strength", F.coalesce("episodes", L(0)).alias("episodes"), F.coalesce("concepts", L(0)).alias("concepts"))


@query("b15_status", """SELECT user_id, (SELECT count(*) FROM {episodes} e WHERE e.user_id = u.user_id) AS episodes, (SELECT count(*) FROM {claims} c WHERE c.user_id = u.user_id) AS claims,
    (SELECT count(*) FROM {concepts} k WHERE k.user_id = u.user_id AND state = 'dormant') AS dormant FROM (SELECT DISTINCT user_id FROM {claims}) u""")  # fmt: skip
def _(t):
    n = lambda df, c: df.groupBy("user_id").agg(F.count(L(1)).alias(c))
    out = n(t("claims"), "claims").join(n(t("episodes"), "episodes"), "user_id", "left").join(n(t("concepts").where("state = 'dormant'"), "dormant"), "user_id", "left")
    return out.select("user_id", *[F.coalesce(c, L(0)).alias(c) for c in ("episodes", "claims", "dormant")])


@query("g17_borrow")
def _(t):
    """The best off-topic fragment in the direction that the topic leaves unexplained."""
    import numpy as np

    from mnemoloom.operators import kernels as K

    f = t("fragments").select("user_id", C("frag_id").alias("id"), "embedding", "cluster")
    q = t("claims").where("vec_id % 20 = 0").select("user_id", C("claim_id").alias("query"), C("embedding").alias("qvec"), C("concept_id").alias("topic"))

    def run(frame, v):
        x = np.array(frame["qvec"].iloc[0], dtype=float)
        on = (frame["cluster"] == frame["topic"]).to_numpy()
        d = K.residual_direction(x, v[on])
        s = np.where(on, -1.0, v @ d)
        i = int(np.argmax(np.round(s, 12)))
        return [(frame["id"][i], round(float(s[i]), 4))] if s[i] >= 0.25 else []

    from mnemoloom.operators import knn

    hits = knn.nearest(q.withColumnRenamed("qvec", "embedding"), f, 40, "query", "id").select(C("probe").alias("query"), C("hit").alias("id"))
    pool = hits.join(f.drop("user_id"), "id").join(q.drop("user_id"), "query")
    return P.per_group(pool, ["query"], "id string, cos double", run)
