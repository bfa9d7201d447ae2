"""Graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.operators import graph
from mnemoloom.plans.base import query
from mnemoloom.plans.vectors import _CONCEPT_MEAN, _by_name, _knn_sql, nearest_concepts, unit_means

C, L = F.col, F.lit

_EDGES = """edges AS (SELECT concept_id AS a, claim_id AS b, 1.0::DOUBLE AS w FROM {members} UNION ALL
    SELECT from_id, to_id, least(1.0, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END) FROM {relations}),
    adj AS (SELECT src, dst, max(w) AS w FROM (SELECT a AS src, b AS dst, w FROM edges UNION ALL SELECT b, a, w FROM edges) WHERE src <> dst GROUP BY 1, 2),
    deg AS (SELECT src, count(*) AS degree FROM adj GROUP BY 1),
    cap AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rn FROM adj) WHERE rn <= 25)"""


def edges(t):
    return graph.capped(graph.adjacency(t("members"), t("relations")))


@query("gr01_degree_cap", f"WITH {_EDGES} SELECT cap.src, dst, w, degree FROM cap JOIN deg ON deg.src = cap.src")
def _(t):
    return edges(t).select("src", "dst", "w", "degree")


@query("j19_graph_neighbours", """WITH s AS (SELECT concept_id FROM {concepts} WHERE n = 2), e AS (SELECT from_id AS s, to_id AS o, weight FROM {relations} UNION ALL SELECT to_id, from_id, weight FROM {relations})
    SELECT o AS concept_id, max(weight) AS weight FROM e WHERE s IN (SELECT concept_id FROM s) AND starts_with(o, 'cpt_') AND o NOT IN (SELECT concept_id FROM s) GROUP BY 1""")  # fmt: skip
def _(t):
    return graph.related(t("relations"), t("concepts").where("n = 2").select("concept_id"))


_SEEDS = f"""{_CONCEPT_MEAN[5:]}, near AS ({_knn_sql('claims', 'claim_id', 12).format(claims='{claims}')} UNION ALL
    SELECT probe, hit, sim, rn FROM (SELECT probe, hit, sim, row_number() OVER (PARTITION BY probe ORDER BY round(sim, 9) DESC, hit) AS rn FROM s WHERE cast(substring(probe, 5) AS BIGINT) % 20 = 0) WHERE rn <= 5),
    seeds AS (SELECT concat('q', cast(substring(probe, 5) AS BIGINT) // 40) AS query, hit AS node, probe, round(sim, 4) AS value FROM near WHERE round(sim, 4) > 0.15)"""


def seeds(t):
    """Every twentieth claim is a probe, two of them make a query: the 12 nearest claims and 5 nearest concepts of each probe."""
    own = t("claims").where("vec_id % 20 = 0")
    near = _by_name(t, "claims", "claim_id", graph.SEED_CLAIMS).select("probe", "hit", "sim").unionByName(nearest_concepts(t, graph.SEED_CONCEPTS, own).select("probe", "hit", "sim"))
    number = F.floor(F.substring("probe", 5, 20).cast("long") / 40)
    found = near.select(F.concat(L("q"), number).alias("query"), C("hit").alias("node"), "probe", F.round("sim", 4).alias("value"))
    return found.where(C("value") > graph.SEED_SIM)


def node_vectors(t):
    """(node, v) of claims and concepts."""
    return t("claims").select(C("claim_id").alias("node"), C("embedding").cast("array<double>").alias("v")).unionByName(unit_means(t).select(C("concept_id").alias("node"), C("embedding").alias("v")))


@query("gr02_seeds", f"WITH {_SEEDS} SELECT query, node, probe, value FROM seeds")
def _(t):
    return seeds(t)


_HOP1 = f"""{_EDGES}, {_SEEDS}, lit0 AS (SELECT query, node, probe, max(value) AS value FROM seeds GROUP BY 1, 2, 3),
    h1 AS (SELECT query, dst AS node, probe, max(value * w / sqrt(degree)) AS value FROM lit0 JOIN cap ON cap.src = node JOIN deg ON deg.src = node GROUP BY 1, 2, 3 HAVING max(value * w / sqrt(degree)) >= 0.04),
    lit1 AS (SELECT query, node, probe, max(value) AS value FROM (SELECT * FROM lit0 UNION ALL SELECT * FROM h1) GROUP BY 1, 2, 3)"""


@query("gr03_one_hop", f"WITH {_HOP1} SELECT query, node, probe, round(value, 6) AS value FROM lit1")
def _(t):
    return graph.spread(seeds(t), edges(t), hops=1).select("query", "node", "probe", F.round("value", 6).alias("value"))


@query("gr03_spread")
def _(t):
    """Two hops, deposits weakened by what the lit nodes explain already, with the stop by value of information."""
    return graph.spread(seeds(t), edges(t), condition=graph.unexplained(node_vectors(t)))


@query("gr04_salience", f"""WITH {_HOP1}, n AS (SELECT query, node, max(value) AS strength, count(DISTINCT probe) AS confluence FROM lit1 GROUP BY 1, 2)
    SELECT n.query, n.node, round(strength, 6) AS strength, confluence, round(strength * (1 + ln(confluence)) * power(1 + ln(1 + coalesce(degree, 0)), -0.5), 6) AS salience FROM n LEFT JOIN deg ON deg.src = n.node""")  # fmt: skip
def _(t):
    e = edges(t)
    s = graph.salience(graph.spread(seeds(t), e, hops=1), e)
    return s.select("query", "node", F.round("strength", 6).alias("strength"), "confluence", F.round("salience", 6).alias("salience"))


@query("gr05_headline", """SELECT claim_id, least(2.0, 0.5 + strength / 2) * CASE WHEN background = 1 THEN 0.5 ELSE 1.0 END AS score,
    concat_ws(',', CASE WHEN strength >= 2.0 THEN 'recurring' END, CASE WHEN days_inactive >= 45 THEN 'resurfacing' END, CASE WHEN background = 1 THEN 'background' END) AS signals FROM {claims}""")  # fmt: skip
def _(t):
    marks = F.array_compact(F.array(F.when(C("strength") >= 2.0, L("recurring")), F.when(C("days_inactive") >= 45, L("resurfacing")), F.when(C("background") == 1, L("background"))))
    return t("claims").select("claim_id", graph.headline(None).alias("score"), F.array_join(marks, ",").alias("signals"))


@query("gr07_relation_promotion", """SELECT s.claim_id AS from_id, r.to_id, 'contradicts' AS relation FROM {relations} r JOIN (SELECT episode_id, min(claim_id) AS claim_id FROM {support} GROUP BY 1) s
    ON s.episode_id = concat('ep_', r.seq % 200) WHERE r.relation = 'contradicts' AND s.claim_id <> r.to_id""")  # fmt: skip
def _(t):
    """Contradiction receipts become edges from the episode's first claim."""
    first = t("support").groupBy("episode_id").agg(F.min("claim_id").alias("claim_id"))
    r = t("relations").where("relation = 'contradicts'").withColumn("episode_id", F.concat(L("ep_"), C("seq") % 200))
    return r.join(first, "episode_id").where("claim_id <> to_id").select(C("claim_id").alias("from_id"), "to_id", L("contradicts").alias("relation"))


@query("gr08_reconcile", """WITH p AS (SELECT least(from_id, to_id) AS lo, greatest(from_id, to_id) AS hi, min(seq) AS seq FROM {relations} WHERE relation = 'contradicts' GROUP BY 1, 2)
    SELECT lo, hi, CASE WHEN a.strength - b.strength >= 1.0 THEN lo WHEN b.strength - a.strength >= 1.0 THEN hi END AS current_id,
    CASE WHEN abs(a.strength - b.strength) >= 1.0 THEN 'supersede' ELSE 'version' END AS mode FROM p JOIN {claims} a ON a.claim_id = lo JOIN {claims} b ON b.claim_id = hi""")  # fmt: skip
def _(t):
    """Contradicting pairs: a margin of strength supersedes, else both stay as versions."""
    p = t("relations").where("relation = 'contradicts'").select(F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi")).distinct()
    of = lambda c: t("claims").select(C("claim_id").alias(c), C("strength").alias(f"s_{c}"))
    d = C("s_lo") - C("s_hi")
    j = p.join(of("lo"), "lo").join(of("hi"), "hi")
    return j.select("lo", "hi", F.when(d >= 1.0, C("lo")).when(d <= -1.0, C("hi")).alias("current_id"), F.when(F.abs(d) >= 1.0, "supersede").otherwise("version").alias("mode"))


@query("gr09_version_groups", "SELECT claim_id, version_group, count(*) OVER (PARTITION BY version_group) > 1 AS contested FROM {claims} WHERE version_group IS NOT NULL")
def _(t):
    n = t("claims").where("version_group is not null").groupBy("version_group").agg(F.count(L(1)).alias("n"))
    return t("claims").join(n, "version_group").select("claim_id", "version_group", (C("n") > 1).alias("contested"))


@query("x04_cofiring", """WITH f AS (SELECT concat('q', vec_id % 50) AS q, concept_id, max(strength) AS s FROM {claims} GROUP BY 1, 2)
    SELECT a.concept_id AS lo, b.concept_id AS hi, count(*) AS support, round(sum(least(a.s, b.s)), 4) AS weight FROM f a JOIN f b ON a.q = b.q AND a.concept_id < b.concept_id GROUP BY 1, 2 HAVING count(*) >= 2""")  # fmt: skip
def _(t):
    """Concepts that fire together: pairs inside a query's short list of concepts."""
    f = t("claims").groupBy(F.concat(L("q"), C("vec_id") % 50).alias("q"), "concept_id").agg(F.max("strength").alias("s"))
    lists = f.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("concept_id", "s"))).alias("l"))
    a = lists.select(F.posexplode("l").alias("i", "x"), "l").select("x", F.explode(F.slice("l", C("i") + 2, F.size("l"))).alias("y"))
    g = a.groupBy(C("x.concept_id").alias("lo"), C("y.concept_id").alias("hi")).agg(F.count(L(1)).alias("support"), F.round(F.sum(F.least("x.s", "y.s")), 4).alias("weight"))
    return g.where("support >= 2")
