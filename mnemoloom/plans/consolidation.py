"""Steps of the batch consolidation with deterministic policies in place of a language model's judgement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoloom.functions import ids
from mnemoloom.operators import kernels as K
from mnemoloom.operators import predictor as P
from mnemoloom.operators import relational as R
from mnemoloom.plans.base import query
from mnemoloom.plans.geometry import corpus, next_concepts
from mnemoloom.plans.vectors import _CONCEPT_MEAN, nearest_concepts

C, L = F.col, F.lit


@query("k02_canonicalise", """WITH raw AS (SELECT user_id, vec_id AS seq, concat('clm_', md5(concat(user_id, chr(0), lower(trim(text))))) AS id FROM {claims})
    SELECT user_id, id, min(seq) AS first_seq, count(*) - 1 AS supports, 1.0 + 0.5 * (count(*) - 1) AS strength FROM raw GROUP BY 1, 2""")  # fmt: skip
def _(t):
    """Same text, same id: the first occurrence creates a claim, later ones support it."""
    raw = t("claims").select("user_id", C("vec_id").alias("seq"), ids.claim_id(C("user_id"), C("text")).alias("id"))
    n = F.count(L(1)) - 1
    return raw.groupBy("user_id", "id").agg(F.min("seq").alias("first_seq"), n.alias("supports"), (1.0 + 0.5 * n).cast("double").alias("strength"))


_PASS = _CONCEPT_MEAN + """, near AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(sim, 9) DESC, hit) AS rn FROM s)
    SELECT probe AS claim_id, CASE WHEN round(sim, 9) >= 0.40 THEN 'attach' ELSE 'create' END AS action, CASE WHEN round(sim, 9) >= 0.40 THEN hit END AS concept_id FROM near WHERE rn = 1"""


@query("k03_concept_pass", _PASS)
def _(t):
    """The judge's default policy: attach to the best plausible concept, else create one."""
    ok = F.round("sim", 9) >= 0.40
    return nearest_concepts(t).select(C("probe").alias("claim_id"), F.when(ok, "attach").otherwise("create").alias("action"), F.when(ok, C("hit")).alias("concept_id"))


@query("k04_valid_decisions", """SELECT r.from_id, r.to_id FROM {relations} r WHERE r.from_id IN (SELECT concept_id FROM {concepts}) AND r.to_id IN (SELECT concept_id FROM {concepts})""")
def _(t):
    """Decisions count only if all that they name exists."""
    c = t("concepts")
    r = t("relations").join(c.select(C("concept_id").alias("from_id")), "from_id", "left_semi")
    return r.join(c.select(C("concept_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")


@query("k09_recluster_counts", _CONCEPT_MEAN + ", a AS (SELECT probe, hit, row_number() OVER (PARTITION BY probe ORDER BY round(sim, 9) DESC, hit) AS rn FROM s) SELECT hit AS concept_id, count(*) AS n FROM a WHERE rn = 1 GROUP BY 1")
def _(t):
    """Sizes of the concepts after every claim moves to the nearest centre."""
    return nearest_concepts(t).groupBy(C("hit").alias("concept_id")).agg(F.count(L(1)).alias("n"))


@query("k10_query_injection", """WITH q AS (SELECT user_id, text, max(vec_id) AS newest FROM {claims} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS rn FROM q)
    SELECT user_id, concat('qclm_', md5(concat(user_id, chr(0), lower(trim(text))))) AS id FROM r WHERE rn <= 200""")  # fmt: skip
def _(t):
    """The newest distinct queries of each user, at most 200, as query-claims."""
    q = t("claims").groupBy("user_id", "text").agg(F.max("vec_id").alias("newest"))
    return R.top_n(q, ["user_id"], [F.desc("newest")], 200).select("user_id", ids.claim_id(C("user_id"), C("text"), "qclm_").alias("id"))


@query("k17_merge_guard")
def _(t):
    """Of each concept's claims, those that the next concept explains fold into it, the rest are kept."""
    by, pools = ["user_id", "cluster"], next_concepts(corpus(t))
    r = P.against(corpus(t), pools, by).join(P.priors(pools, by), by)
    z = F.when(C("n") < 2, 0.0).otherwise((C("residual") - C("prior_mu")) / F.greatest("prior_sd", L(K.SD_FLOOR)))
    some = F.max(C("fold").cast("int")).over(Window.partitionBy(*by)) == 1
    return r.withColumn("fold", z <= -0.5).select(*by, "id", F.when(some, C("fold")).otherwise(True).alias("fold"))


@query("k18_snapshot", """SELECT c.concept_id, c.label, c.state, string_agg(m.claim_id, ',' ORDER BY m.claim_id) AS members FROM {concepts} c JOIN {members} m ON m.concept_id = c.concept_id AND m.kind = 'primary' GROUP BY 1, 2, 3""")
def _(t):
    m = t("members").where("kind = 'primary'").groupBy("concept_id").agg(F.array_join(F.sort_array(F.collect_list("claim_id")), ",").alias("members"))
    return t("concepts").select("concept_id", "label", "state").join(m, "concept_id")


@query("g06_demand_medoid")
def _(t):
    """Medoid of primary and query members together."""
    extra = t("members").where("kind = 'redundant'").select(C("concept_id").alias("cluster"), C("claim_id").alias("id"))
    more = corpus(t).drop("cluster").join(extra, "id").select("user_id", "id", "embedding", "cluster")
    both = corpus(t).unionByName(more).dropDuplicates(["cluster", "id"])
    return P.per_group(both.drop("user_id").select("cluster", "id", "embedding"), ["cluster"], "medoid string", lambda f, v: [(f["id"][K.medoid(v)],)])


@query("g09_concept_geometry")
def _(t):
    """The hint that a judge gets of each concept: its medoid and whether it is one thing or two."""
    return P.per_group(corpus(t), ["user_id", "cluster"], "medoid string, shape string", lambda f, v: [(f["id"][K.medoid(v)], "two poles" if K.bimodal(v) else "one")])


@query("g18_kmeans_fallback")
def _(t):
    """Clusters of an episode's fragments where there is no blueprint: k by the root of their number, between 2 and 6."""
    f = t("fragments").select("episode_id", C("frag_id").alias("id"), "embedding")
    return P.per_group(f, ["episode_id"], "id string, cluster int", lambda g, v: list(zip(g["id"], K.kmeans(v, max(2, min(6, int(len(v) ** 0.5)))).tolist())))


@query("x01_reach", """SELECT user_id, round(avg(CASE WHEN concept_id IN (SELECT concept_id FROM {concepts} WHERE n < 5) THEN 1 ELSE 0 END), 6) AS reach FROM {claims} GROUP BY 1""")
def _(t):
    """Share of facts whose claim belongs to a chosen set of concepts."""
    chosen = t("concepts").where("n < 5").select("concept_id", L(1).alias("hit"))
    j = t("claims").select("user_id", "concept_id").join(chosen, "concept_id", "left")
    return j.groupBy("user_id").agg(F.round(F.avg(F.coalesce("hit", L(0))), 6).alias("reach"))


@query("h05_profile", "SELECT user_id, max_by(value, seq) AS value FROM {log} WHERE type = 'DECAYED' GROUP BY 1")
def _(t):
    """The last saved profile of each user."""
    return t("log").where("type = 'DECAYED'").groupBy("user_id").agg(F.max_by("value", "seq").alias("value"))


@query("sc16_embed")
def _(t):
    """Vectors of texts from the built-in embedder."""
    from mnemoloom.sources.embedder import embedder

    e = t("benchmark").select("item_id", embedder(16)(C("text")).alias("v"))
    return e.select("item_id", F.round(F.sqrt(F.aggregate("v", L(0.0), lambda s, x: s + x * x)), 4).alias("norm"))
