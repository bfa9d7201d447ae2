"""Vector and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.operators import bm25, knn
from mnemoloom.plans.base import query

C, L = F.col, F.lit

_DOT = "list_dot_product(cast(p.embedding AS DOUBLE[]), cast(c.embedding AS DOUBLE[]))"


def _knn_sql(corpus: str, key: str, k: int, where: str = "TRUE", probe_where: str = "p.vec_id % 20 = 0", extra: str = "") -> str:
    return f"""SELECT probe, hit, sim, rn{extra} FROM (SELECT p.claim_id AS probe, c.{key} AS hit, round({_DOT}, 4) AS sim,
        row_number() OVER (PARTITION BY p.claim_id ORDER BY round({_DOT}, 9) DESC, c.{key}) AS rn
        FROM {{claims}} p JOIN {{{corpus}}} c ON c.user_id = p.user_id AND c.vec_id <> p.vec_id WHERE {probe_where} AND {where}) WHERE rn <= {k}"""


def _by_name(t, corpus, key, k, where="true", probes="vec_id % 20 = 0"):
    """Ties go by the hit's own id, so ids are the block rows' keys."""
    c = t(corpus).where(where)
    p = t("claims").where(probes).select("user_id", "embedding", C("claim_id").alias("probe_id"), C("vec_id").alias("pv"))
    hits = knn.nearest(p, c, k + 1, "probe_id", key)
    own = c.select(C(key).alias("hit"), C("vec_id").alias("cv"))
    from pyspark.sql import Window

    w = Window.partitionBy("probe").orderBy(F.desc(F.round("sim", 9)), "hit")
    others = hits.drop("rn").join(own, "hit").where(F.concat(L("clm_"), "cv") != C("probe"))
    return others.withColumn("rn", F.row_number().over(w)).where(C("rn") <= k)


@query("v01_knn_claims", _knn_sql("claims", "claim_id", 5))
def _(t):
    return _by_name(t, "claims", "claim_id", 5).select("probe", "hit", F.round("sim", 4).alias("sim"), C("rn").cast("long").alias("rn"))


@query("v02_knn_sentences", f"SELECT k.*, e.title FROM ({_knn_sql('fragments', 'frag_id', 5)}) k JOIN {{fragments}} f ON f.frag_id = k.hit JOIN {{episodes}} e ON e.episode_id = f.episode_id")
def _(t):
    """With the episode each hit stands in."""
    hits = _by_name(t, "fragments", "frag_id", 5).select("probe", "hit", F.round("sim", 4).alias("sim"), C("rn").cast("long").alias("rn"))
    f = t("fragments").select(C("frag_id").alias("hit"), "episode_id")
    return hits.join(f, "hit").join(t("episodes").select("episode_id", "title"), "episode_id").drop("episode_id")


@query("v04_knn_fragments", _knn_sql("fragments", "frag_id", 5, "c.medoid_idx IS NOT NULL"))
def _(t):
    """Medoids alone are searched: filtered first, then exact, so no widening loop."""
    return _by_name(t, "fragments", "frag_id", 5, "medoid_idx is not null").select("probe", "hit", F.round("sim", 4).alias("sim"), C("rn").cast("long").alias("rn"))


@query("v05_candidates", f"SELECT k.probe, k.hit, k.rn, e.title, f.cluster FROM ({_knn_sql('fragments', 'frag_id', 40, 'c.medoid_idx IS NOT NULL', 'p.vec_id % 20 = 0')}) k JOIN {{fragments}} f ON f.frag_id = k.hit JOIN {{episodes}} e ON e.episode_id = f.episode_id")
def _(t):
    hits = _by_name(t, "fragments", "frag_id", 40, "medoid_idx is not null", "vec_id % 20 = 0").select("probe", "hit", C("rn").cast("long").alias("rn"))
    f = t("fragments").select(C("frag_id").alias("hit"), "episode_id", "cluster")
    return hits.join(f, "hit").join(t("episodes").select("episode_id", "title"), "episode_id").drop("episode_id")


@query("v06_frag_cosine", f"SELECT p.claim_id AS query, c.frag_id, c.episode_id, round({_DOT}, 4) AS sim FROM {{fragments}} c JOIN {{claims}} p ON p.user_id = c.user_id WHERE p.vec_id % 20 = 0 AND c.episode_id IN ('ep_0', 'ep_4', 'ep_8', 'ep_5')")
def _(t):
    """Fragments of given episodes against a query of their user."""
    p = t("claims").where("vec_id % 20 = 0").select("user_id", C("claim_id").alias("query"), "embedding")
    f = t("fragments").where(C("episode_id").isin("ep_0", "ep_4", "ep_8", "ep_5"))
    made = knn.products(p, f, "query", "frag_id", "episode_id").select(C("probe").alias("query"), C("hit").alias("frag_id"), C("tag").alias("episode_id"), F.round("sim", 4).alias("sim"))
    pair = lambda a, b: a.select("user_id", "query").join(b.select("user_id", "frag_id", "episode_id"), "user_id").select("query", "frag_id", "episode_id", L(None).cast("double").alias("sim"))
    return made.unionByName(pair(p.where("embedding is null"), f)).unionByName(pair(p.where("embedding is not null"), f.where("embedding is null")))


@query("v07_stored_vectors", "SELECT claim_id, round(cast(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS dim FROM {claims} WHERE user_id = 'u0'")
def _(t):
    return t("claims").where("user_id = 'u0'").select("claim_id", F.round(F.get("embedding", L(0)).cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dim"))


_BM25 = """WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {documents}),
    len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM {documents}), st AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {benchmark}),
    sc AS (SELECT q.item_id, tf.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.n / mean))) AS score
    FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term JOIN len ON len.doc_id = tf.doc_id CROSS JOIN st GROUP BY 1, 2),
    ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rn FROM sc)
    SELECT item_id, doc_id, round(score, 4) AS score, rn FROM ranked WHERE rn <= 20"""


@query("v08_bm25_top20", _BM25)
def _(t):
    hits = bm25.search(t("documents"), t("benchmark").withColumnRenamed("text", "q"), "doc_id", "text", "item_id", "q", 20)
    return hits.select("item_id", "doc_id", F.round("score", 4).alias("score"), C("rn").cast("long").alias("rn"))


_CONCEPT_MEAN = """WITH m AS (SELECT concept_id, user_id, pos, avg(x) AS x FROM (SELECT concept_id, user_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(cast(embedding AS DOUBLE[])) AS x FROM {claims}) GROUP BY 1, 2, 3),
    c AS (SELECT concept_id, user_id, list(x ORDER BY pos) AS v, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1, 2),
    s AS (SELECT p.claim_id AS probe, c.concept_id AS hit, list_dot_product(cast(p.embedding AS DOUBLE[]), c.v) / c.norm AS sim FROM {claims} p JOIN c ON c.user_id = p.user_id)"""


def unit_means(t):
    """(concept_id, user_id, embedding): the unit mean of each concept, aggregated by place so partial sums meet."""
    x = t("claims").select("concept_id", "user_id", F.posexplode("embedding").alias("pos", "x"))
    m = x.groupBy("concept_id", "user_id", "pos").agg(F.avg(C("x").cast("double")).alias("x"))
    g = m.groupBy("concept_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"), F.sqrt(F.sum(C("x") * C("x"))).alias("norm"))
    return g.select("concept_id", "user_id", F.transform("p", lambda e: e["x"] / C("norm")).alias("embedding"))


def nearest_concepts(t, k=1, claims=None):
    """(probe, hit, sim, rn): the concepts of greatest cosine for each claim of a user."""
    p = (t("claims") if claims is None else claims).select("user_id", C("claim_id").alias("probe_id"), "embedding")
    return knn.nearest(p, unit_means(t), k, "probe_id", "concept_id").select("probe", "hit", "sim", C("rn").cast("long").alias("rn"))


@query("v03_knn_concepts", _CONCEPT_MEAN + " SELECT probe, hit, round(sim, 4) AS sim, rn FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(sim, 9) DESC, hit) AS rn FROM s) WHERE rn <= 1")
def _(t):
    return nearest_concepts(t).select("probe", "hit", F.round("sim", 4).alias("sim"), "rn")


@query("v09_fact_scores", f"SELECT probe AS fact, sim AS score, sim >= 0.4 AS covered FROM ({_knn_sql('fragments', 'frag_id', 1)})")
def _(t):
    """Greatest cosine of each fact over its user's chunks, and whether it covers the fact by a threshold that suits the data."""
    score = F.round("sim", 4)
    return _by_name(t, "fragments", "frag_id", 1).select(C("probe").alias("fact"), score.alias("score"), (score >= 0.4).alias("covered"))


@query("h07_unit_mean", _CONCEPT_MEAN.split("\n    s AS")[0].rstrip().rstrip(",") + " SELECT concept_id, round(norm, 6) AS norm, round(v[1] / norm, 6) AS first FROM c")
def _(t):
    x = t("claims").select("concept_id", F.posexplode("embedding").alias("pos", "x")).groupBy("concept_id", "pos").agg(F.avg(C("x").cast("double")).alias("x"))
    g = x.groupBy("concept_id").agg(F.sqrt(F.sum(C("x") * C("x"))).alias("norm"), F.min_by("x", "pos").alias("first"))
    return g.select("concept_id", F.round("norm", 6).alias("norm"), F.round(C("first") / C("norm"), 6).alias("first"))


@query("b11_receipt_bands", f"""SELECT probe, hit, sim, CASE WHEN sim >= 0.4 THEN 'echo' WHEN sim < 0.3 THEN 'novel' ELSE 'silent' END AS band
    FROM ({_knn_sql('claims', 'claim_id', 1, 'TRUE', 'p.vec_id % 20 = 0')})""")  # fmt: skip
def _(t):
    """The receipt of new items: what each echoes most, with a band by thresholds that suit the data."""
    hits = _by_name(t, "claims", "claim_id", 1)
    sim = F.round("sim", 4)
    return hits.select("probe", "hit", sim.alias("sim"), F.when(sim >= 0.4, "echo").when(sim < 0.3, "novel").otherwise("silent").alias("band"))
