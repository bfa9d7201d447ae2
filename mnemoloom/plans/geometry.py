"""Residual geometry, segmentation, selection and consolidation steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoloom.operators import kernels as K
from mnemoloom.operators import knn
from mnemoloom.operators import predictor as P
from mnemoloom.operators import relational as R
from mnemoloom.plans.base import query
from mnemoloom.plans.vectors import _CONCEPT_MEAN, nearest_concepts, unit_means

C, L = F.col, F.lit


def corpus(t):
    return t("claims").select("user_id", C("claim_id").alias("id"), "embedding", C("concept_id").alias("cluster"))


def probes(t):
    return t("claims").where("vec_id % 20 = 0").select("user_id", C("claim_id").alias("id"), "embedding")


def rounded(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else C(c) for c in df.columns])


@query("r09_measure")
def _(t):
    """Residual and z of every twentieth claim against its user's corpus."""
    return rounded(P.measure(probes(t), corpus(t)), residual=4, z=3, nearest_sim=4, peer_mean=4, peer_std=4)


@query("r13_prediction_error")
def _(t):
    return P.route(P.measure(probes(t), corpus(t)), ["user_id"])


@query("r08_baselines")
def _(t):
    """Mean and spread of leave-one-out residuals by concept, shrunk by size."""

    base, _ = P.baselines(corpus(t))
    return base.select("user_id", "cluster", F.round("mu", 4).alias("mu"), F.round("sd", 4).alias("sd"))


@query("r07_corpus_prior")
def _(t):
    _, prior = P.baselines(corpus(t))
    return prior.select("user_id", F.round("prior_mu", 4).alias("prior_mu"), F.round("prior_sd", 4).alias("prior_sd"))


@query("r03_residual")
def _(t):
    """Residual of every claim against its user's other claims."""
    return P.loo_residuals(corpus(t), ["user_id"]).select("user_id", "id", F.round("residual", 4).alias("residual"))


@query("r06_loo_residual")
def _(t):
    """Residual of every claim against its concept's other claims."""
    return P.loo_residuals(corpus(t), ["user_id", "cluster"]).select("user_id", "cluster", "id", F.round("residual", 4).alias("residual"))


@query("r05_residual_direction")
def _(t):
    """How far each claim points away from its concept, and where."""
    return P.per_group(corpus(t), ["user_id", "cluster"], "id string, first double", lambda f, v: [(i, round(float(K.residual_direction(v[k], np.delete(v, k, axis=0))[0]), 4)) for k, i in enumerate(f["id"])])


@query("r10_route", """WITH m AS (SELECT frag_id, episode_id, user_id, residual, z, residual AS sim, 0.5::DOUBLE AS pm, 0.1::DOUBLE AS ps, sent_start = 0 AS cold FROM {fragments}),
    r AS (SELECT *, CASE WHEN cold THEN 'NOVEL' WHEN z <= -3.5 THEN 'PREDICTED' WHEN sim >= pm - ps THEN 'AMBIGUOUS' ELSE 'NOVEL' END AS route FROM m),
    w AS (SELECT *, sum(CASE WHEN route <> 'PREDICTED' THEN residual ELSE 0 END) OVER (PARTITION BY user_id, episode_id) AS total FROM r)
    SELECT frag_id, route, route <> 'PREDICTED' AS store, CASE WHEN route <> 'PREDICTED' AND total > 0 THEN round(residual / total, 4) ELSE 0 END AS weight FROM w""")  # fmt: skip
def _(t):
    """Routing as column expressions over given measurements."""
    m = t("fragments").select("frag_id", "user_id", "episode_id", "residual", "z", C("residual").alias("nearest_sim"), L(0.5).alias("peer_mean"), L(0.1).alias("peer_std"), (C("sent_start") == 0).alias("cold"), L("a").alias("anchor"))
    return P.route(m, ["user_id", "episode_id"]).select("frag_id", "route", "store", "weight")


@query("r12_stance_off", "SELECT from_id, to_id, CASE WHEN relation = 'contradicts' THEN 'contradict' ELSE 'refine' END AS direction FROM {relations}")
def _(t):
    """Direction from a stance label; without a classifier the label is neutral and the direction refines."""
    return t("relations").select("from_id", "to_id", F.when(C("relation") == "contradicts", "contradict").otherwise("refine").alias("direction"))


_SEQ = "seqs AS (SELECT vec_id // 12 AS ep, vec_id % 12 AS idx, embedding FROM {claims})"
_CURVE = f"""{_SEQ}, curve AS (SELECT a.ep, a.idx, CASE WHEN a.idx >= 2 THEN max(list_dot_product(cast(a.embedding AS DOUBLE[]), cast(b.embedding AS DOUBLE[]))) END AS sim
    FROM seqs a LEFT JOIN seqs b ON b.ep = a.ep AND b.idx < a.idx GROUP BY 1, 2)"""
_Z = f"""{_CURVE}, med AS (SELECT ep, quantile_cont(sim, 0.5) AS m, count(sim) AS n FROM curve GROUP BY 1), mad AS (SELECT c.ep, quantile_cont(abs(sim - m), 0.5) AS d FROM curve c JOIN med ON med.ep = c.ep GROUP BY 1),
    zs AS (SELECT c.ep, c.idx, sim, CASE WHEN n >= 2 THEN (sim - m) / greatest(0.06, 1.4826 * d) END AS z FROM curve c JOIN med ON med.ep = c.ep JOIN mad ON mad.ep = c.ep)"""


def sequences(t):
    return t("claims").select(F.floor(C("vec_id") / 12).alias("ep"), (C("vec_id") % 12).alias("idx"), "embedding", C("claim_id").alias("text"))


def curve(t):
    return P.causal_nearest(sequences(t), "ep", "idx")


@query("sg01_causal_nn", f"WITH {_CURVE} SELECT ep, idx, round(sim, 4) AS sim FROM curve")
def _(t):
    return curve(t).select("ep", "idx", F.round("sim", 4).alias("sim"))


@query("sg02_mad_spread", f"WITH {_Z} SELECT ep, idx, round(z, 4) AS z FROM zs")
def _(t):
    return P.robust_z(curve(t), "ep").select("ep", "idx", F.round("z", 4).alias("z"))


@query("sg03_boundaries", f"WITH {_Z} SELECT ep, idx FROM zs WHERE z <= -1.5")
def _(t):
    return P.robust_z(curve(t), "ep").where(C("z") <= P.DROP).select("ep", "idx")


@query("sg04_segments", f"WITH {_Z} SELECT ep, idx, cast(sum(CASE WHEN z <= -1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY ep ORDER BY idx) AS BIGINT) AS segment FROM zs")
def _(t):
    return P.islands(P.robust_z(curve(t), "ep"), "ep", "idx", F.coalesce(C("z") <= P.DROP, L(False))).select("ep", "idx", "segment")


_FRAGS = f"""{_Z}, isl AS (SELECT ep, idx, cast(sum(CASE WHEN z <= -0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY ep ORDER BY idx) AS BIGINT) AS segment FROM zs),
    fr AS (SELECT ep, segment, min(idx) AS start, max(idx) AS "end", string_agg(concat('clm_', ep * 12 + idx), ' ' ORDER BY idx) AS text FROM isl GROUP BY 1, 2)"""


@query("sg05_islands", f'WITH {_FRAGS} SELECT ep, segment, start, "end", text FROM fr')
def _(t):
    j = P.robust_z(curve(t), "ep").join(sequences(t).select("ep", "idx", "text"), ["ep", "idx"])
    return P.fragments(j, "ep", "idx", "text")


@query("sg06_decompose_query")
def _(t):
    """Sub-queries of user turns: segments of their sentences by meaning, or every sentence where there is one segment."""
    from mnemoloom.functions import text
    from mnemoloom.sources.embedder import embedder

    q = t("conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text").distinct()
    s = q.select("turn_id", F.posexplode(text.sentences(C("text"), 1)).alias("idx", "sentence"))
    return P.decompose(s.withColumn("embedding", embedder()(C("sentence"))), "turn_id", "idx", "sentence")


@query("g01_assemble")
def _(t):
    """Up to six claims for each query by marginal residual, out of all other claims of its user."""
    return P.assemble_whole(probes(t), corpus(t))


@query("g02_safe_forget")
def _(t):
    return P.per_group(corpus(t), ["user_id", "cluster"], "id string, droppable boolean", lambda f, v: list(zip(f["id"], K.droppable(v))))


def next_concepts(rows):
    """Claims as the pool of the concept before theirs by number, of the last one for the first."""
    number = (F.substring_index("cluster", "_", -1).cast("int") + 1) % 10
    return rows.withColumn("cluster", F.concat(F.substring_index("cluster", "_", 2), L("_"), number))


@query("g04_merge_residual")
def _(t):
    """Each concept's claims against the next concept's: which a merge could fold."""
    r = P.against(corpus(t), next_concepts(corpus(t)), ["user_id", "cluster"])
    return r.select("user_id", "cluster", "id", F.round("residual", 4).alias("residual"))


@query("g05_medoid", """WITH s AS (SELECT concept_id, pos, sum(x) AS x FROM (SELECT concept_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(cast(embedding AS DOUBLE[])) AS x FROM {claims}) GROUP BY 1, 2),
    v AS (SELECT concept_id, list(x ORDER BY pos) AS total FROM s GROUP BY 1), d AS (SELECT c.concept_id, claim_id, list_dot_product(cast(embedding AS DOUBLE[]), total) AS score FROM {claims} c JOIN v ON v.concept_id = c.concept_id)
    SELECT concept_id, claim_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY round(score, 9) DESC, claim_id) AS rn FROM d) WHERE rn = 1""")  # fmt: skip
def _(t):
    """Sum of cosines as one dot product with the concept's sum: linear, and partial sums combine."""
    x = t("claims").select("concept_id", F.posexplode("embedding").alias("pos", "x")).groupBy("concept_id", "pos").agg(F.sum(C("x").cast("double")).alias("x"))
    total = x.groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("total"))
    d = t("claims").join(total, "concept_id").select("concept_id", "claim_id", knn.similarity(C("embedding"), C("total")).alias("score"))
    w = Window.partitionBy("concept_id").orderBy(F.desc(F.round("score", 9)), "claim_id")
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("concept_id", "claim_id", F.round("score", 4).alias("score"))


@query("g07_fragment_medoid")
def _(t):
    """The row of each fragment that the rest explains best."""
    c = corpus(t).withColumnRenamed("cluster", "fragment")

    def run(frame, v):
        r = [K.residual(v[i], np.delete(v, i, axis=0)) for i in range(len(v))] if len(v) > 1 else [0.0]
        return [(frame["id"][int(np.argmin(np.round(r, 12)))], round(float(min(r)), 4))]

    return P.per_group(c, ["user_id", "fragment"], "id string, residual double", run)


@query("g08_bimodality")
def _(t):
    return P.per_group(corpus(t), ["user_id", "cluster"], "n int, bimodal boolean", lambda f, v: [(len(f), K.bimodal(v))])


@query("g10_membership_z")
def _(t):
    """z of each claim within its concept; null for concepts of six or fewer."""

    def run(frame, v):
        if len(v) <= 6:
            return [(i, None) for i in frame["id"]]
        prior = K.corpus_prior(v)
        return [(i, round(K.measure(v[k], v, frame["id"].tolist(), [0] * len(v), {0: prior}, prior, k)["z"], 3)) for k, i in enumerate(frame["id"])]

    return P.per_group(corpus(t), ["user_id", "cluster"], "id string, z double", run)


@query("g11_reanchor")
def _(t):
    """The member of each concept that stands out most from the concept's three nearest."""
    m = unit_means(t).select("user_id", "concept_id", "embedding")
    pair = m.join(m.select("user_id", C("concept_id").alias("other"), C("embedding").alias("o")), "user_id").where("concept_id <> other")
    w = Window.partitionBy("concept_id").orderBy(F.desc(knn.similarity(C("embedding"), C("o"))), "other")
    near = pair.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("concept_id", "other")
    pool = near.join(t("claims").select(C("concept_id").alias("other"), "claim_id", C("embedding").alias("v")), "other")
    top60 = Window.partitionBy("concept_id").orderBy("claim_id")
    pools = pool.withColumn("rn", F.row_number().over(top60)).where("rn <= 60").select("concept_id", C("claim_id").alias("id"), C("v").alias("embedding"))
    own = corpus(t).withColumnRenamed("cluster", "concept_id")
    told = P.against(own, pools, ["concept_id"]).withColumnRenamed("residual", "by_others")
    score = told.join(P.loo_residuals(corpus(t), ["cluster"]).select(C("cluster").alias("concept_id"), "id", "residual"), ["concept_id", "id"])
    score = score.select("concept_id", "id", F.round(C("by_others") - C("residual"), 12).alias("score"))
    return R.top_n(score, ["concept_id"], [F.desc("score"), C("id")], 1).select("concept_id", C("id").alias("claim_id"))


@query("g12_channel_holes")
def _(t):
    """Claims near a concept that isn't their home, not quite explained by it: the best for each claim, 80 in all for a user."""
    return rounded(P.channel_holes(corpus(t), unit_means(t), floor=0.2), cos=4, z=3)


@query("g13_route_note")
def _(t):
    """All notes in order against memory that grows from nothing as they are stored."""
    notes = t("claims").select("user_id", C("vec_id").alias("ts"), C("claim_id").alias("id"), "embedding")
    return P.route_notes(notes, corpus(t).limit(0))


@query("g15_region", """SELECT frag_id, CASE WHEN z > 0 THEN frag_id ELSE coalesce(cluster, frag_id) END AS region FROM {fragments}""")
def _(t):
    """Novel fragments open a region, ambiguous ones inherit their anchor's."""
    return t("fragments").select("frag_id", F.when(C("z") > 0, C("frag_id")).otherwise(F.coalesce("cluster", "frag_id")).alias("region"))


@query("g16_centre_and_peak", "SELECT episode_id, min_by(frag_id, struct_pack(residual := residual, f := vec_id)) AS centre, max_by(frag_id, struct_pack(z := z, f := vec_id)) AS peak, round(sum(residual), 4) AS total FROM {fragments} GROUP BY 1")
def _(t):
    f = t("fragments").groupBy("episode_id")
    return f.agg(F.min_by("frag_id", F.struct("residual", "vec_id")).alias("centre"), F.max_by("frag_id", F.struct("z", "vec_id")).alias("peak"), F.round(F.sum("residual"), 4).alias("total"))


@query("g19_blueprint", """SELECT episode_id, cluster, string_agg(text, ' | ' ORDER BY sent_start, vec_id) AS spans, min(sent_start) AS first FROM {fragments} GROUP BY 1, 2""")
def _(t):
    g = t("fragments").groupBy("episode_id", "cluster").agg(F.sort_array(F.collect_list(F.struct("sent_start", "vec_id", "text"))).alias("p"), F.min("sent_start").alias("first"))
    return g.select("episode_id", "cluster", F.array_join(F.transform("p", lambda x: x["text"]), " | ").alias("spans"), "first")


@query("j20_nearest_centroid", _CONCEPT_MEAN + " SELECT probe, hit FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(sim, 9) DESC, hit) AS rn FROM s) WHERE rn = 1")
def _(t):
    """Reclustering: the concept whose centre is nearest."""
    return nearest_concepts(t).select("probe", "hit")


@query("k01_dedup_route")
def _(t):
    """Same, uncertain or new: by measure and route, by bands of cosine where a user has six claims or fewer."""
    return P.dedup_route(probes(t), corpus(t))


@query("k05_integrity")
def _(t):
    """Claims that their source doesn't explain."""
    return P.route(P.measure(probes(t), corpus(t)), ["user_id"]).where("route = 'NOVEL'").select("user_id", "id", F.round("z", 3).alias("z"))


@query("k08_prune")
def _(t):
    """Members of dormant concepts of three or more that the rest explain, never all of them."""
    dormant = t("concepts").where("state = 'dormant'").select(C("concept_id").alias("cluster"))
    c = corpus(t).join(dormant, "cluster", "left_semi").select("user_id", "cluster", "id", "embedding")

    def run(frame, v):
        gone = [i for i, d in zip(frame["id"], K.droppable(v)) if d] if len(v) >= 3 else []
        return [(i,) for i in gone[: len(v) - 1]]

    return P.per_group(c, ["user_id", "cluster"], "id string", run)


@query("x02_representatives")
def _(t):
    """Mean, medoid and outlier of each concept."""

    def run(frame, v):
        centre = v.mean(axis=0)
        return [(frame["id"][K.medoid(v)], frame["id"][int(np.argmin(np.round(v @ centre, 12)))], round(float(np.linalg.norm(centre)), 4))]

    return P.per_group(corpus(t), ["user_id", "cluster"], "medoid string, outlier string, mean_norm double", run)
