"""What would fail on larger tables: joins of a user's rows with each other, pools beside every row, cut candidates."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoloom.operators import bm25, knn
from mnemoloom.operators import kernels as K
from mnemoloom.operators import predictor as P
from mnemoloom.plans import registry, relational

RNG = np.random.default_rng(3)
ROW = "user_id string, id string, embedding array<float>, cluster string"


def unit(n, d=8, centre=None, noise=1.0):
    v = noise * RNG.normal(size=(n, d)) + (0 if centre is None else centre)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def rows(spark, v, user="u", name="r", cluster=None):
    return spark.createDataFrame([(user, f"{name}{i:03d}", x.tolist(), cluster) for i, x in enumerate(v)], ROW)


def plan(spark, sf, name):
    return registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def by_user_alone(text):
    """Joins of all rows of a user with all others."""
    return re.findall(r"Join Inner, \(user_id#\d+ = user_id#\d+\)", text)


def test_b08_searches_in_blocks(spark, sf):
    assert not by_user_alone(plan(spark, sf, "b08_fragment_recall"))


def naive(v, names, query, k):
    chosen, gains, shares, why = K.assemble(v, v @ query, query[None], k)
    return [(names[i], n, round(g, 6), why) for n, (i, g) in enumerate(zip(chosen, gains))]


@pytest.mark.parametrize("width", [2, 5, 64])
def test_g01_chooses_from_all_rows(spark, monkeypatch, width):
    """Copies near the query fill any list of nearest rows; what comes second lies beyond them."""
    monkeypatch.setattr(P, "WIDTH", width)
    q = unit(1)[0]
    v = np.vstack([unit(70, centre=3 * q, noise=0.02), unit(40)])
    corpus = rows(spark, np.vstack([v, [q]]))
    got = P.assemble_whole(corpus.where("id = 'r110'").drop("cluster"), corpus).orderBy("rank").collect()
    want = naive(v.astype(float), [f"r{i:03d}" for i in range(110)], q.astype(float), 6)
    assert [(r.id, r["rank"], round(r.gain, 6), r.stopped) for r in got] == want and any(int(w[0][1:]) >= 70 for w in want)


def test_g01_takes_small_users_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "WIDTH", 2)
    v = unit(4)
    corpus = rows(spark, v).unionByName(rows(spark, v[:1], "alone"))
    got = P.assemble_whole(corpus.where("id = 'r000'").drop("cluster"), corpus).orderBy("rank").collect()
    want = naive(v[1:].astype(float), ["r001", "r002", "r003"], v[0].astype(float), 6)
    assert [(r.id, r["rank"], round(r.gain, 6), r.stopped) for r in got] == want


@pytest.mark.parametrize("name", ["g04_merge_residual", "k17_merge_guard", "g11_reanchor"])
def test_no_group_is_gathered_beside_its_rows(spark, sf, name):
    text = plan(spark, sf, name)
    assert "FlatMapGroupsInPandas" not in text and not re.search(r"AS pool#", text)


@pytest.mark.parametrize("n", [1, 3, 7, 80])
def test_residuals_and_priors_of_pools(spark, n):
    a, b = unit(5), unit(n)
    pool, asked = rows(spark, b, cluster="c"), rows(spark, a, name="a", cluster="c").unionByName(rows(spark, a, name="b", cluster="none"))
    got = {r.id: r.residual for r in P.against(asked, pool, ["user_id", "cluster"]).collect()}
    assert got == pytest.approx({f"a{i:03d}": K.residual(x, b.astype(float)) for i, x in enumerate(a.astype(float))}, abs=1e-6)
    (p,) = P.priors(pool, ["user_id", "cluster"]).collect()
    assert (p.n, p.prior_mu, p.prior_sd) == pytest.approx((n, *K.corpus_prior(b.astype(float))), abs=1e-6)


def routed(notes, memory, z_echo):
    """Each note against all that is stored, one after another."""
    pool, ids, regions = [x for _, x, _ in memory], [i for i, _, _ in memory], [c for *_, c in memory]
    base, prior = K.baselines(np.array(pool), regions) if len(pool) > 1 else ({}, (0.7, 0.2))
    out = {}
    for i, x in notes:
        m = K.measure(x, np.array(pool).reshape(len(pool), len(x)), ids, regions, base, prior)
        near = m["peer_mean"] == m["peer_std"] == 0 or (m["nearest_sim"] or 0) >= m["peer_mean"] - m["peer_std"]
        kind = "NOVEL" if m["cold"] else "PREDICTED" if m["z"] <= z_echo else "AMBIGUOUS" if near else "NOVEL"
        region = i if kind == "NOVEL" else regions[ids.index(m["anchor"])] or i
        out[i] = (kind, region)
        if kind != "PREDICTED":
            pool.append(x), ids.append(i), regions.append(region)
    return out


@pytest.mark.parametrize("held, z", [(0, -1.0), (30, -1.0)])
def test_g13_finds_what_is_stored_where_most_notes_are_not(spark, monkeypatch, held, z):
    monkeypatch.setattr(knn, "PLACES", 50)
    copies, other = unit(120, 16, centre=np.eye(16)[0] * 9, noise=0.05), unit(60, 16)
    v = np.vstack([copies, other])[RNG.permutation(180)].astype(float)
    m = unit(held, 16).astype(float)
    memory = spark.createDataFrame([("u", f"m{i:03d}", x.tolist(), "ab"[i % 2]) for i, x in enumerate(m)], "user_id string, id string, embedding array<float>, cluster string")
    notes = spark.createDataFrame([("u", i, f"n{i:03d}", x.tolist()) for i, x in enumerate(v)], "user_id string, ts long, id string, embedding array<float>")
    got = {r.id: (r.route, r.cluster) for r in P.route_notes(notes, memory, z).collect()}
    want = routed([(f"n{i:03d}", x) for i, x in enumerate(v)], [(f"m{i:03d}", x, "ab"[i % 2]) for i, x in enumerate(m)], z)
    assert got == want and sum(k == "PREDICTED" for k, _ in want.values()) > 24


@pytest.mark.parametrize("name", ["x05_note_ranks", "v06_frag_cosine", "j17_anchor_prior"])
def test_no_dot_products_row_by_row(spark, sf, name):
    assert "zip_with" not in plan(spark, sf, name)


def test_products_and_greatest_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 7)
    a, b = unit(30), unit(50)
    tags = {f"b{i:03d}": "xyz"[0 if i < 40 else i % 3] for i in range(50)}
    corpus = rows(spark, b, name="b").drop("cluster").withColumn("tag", F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])[F.col("id")])
    want = {(f"a{i:03d}", f"b{j:03d}"): float(x.astype(float) @ y.astype(float)) for i, x in enumerate(a) for j, y in enumerate(b)}
    probes = rows(spark, a, name="a")
    got = {(r.probe, r.hit): (r.tag, r.sim) for r in knn.products(probes, corpus, "id", "id", "tag").collect()}
    assert {k: s for k, (_, s) in got.items()} == pytest.approx(want) and all(t == tags[h] for (_, h), (t, _) in got.items())
    best = {(r.probe, r.tag): r.sim for r in knn.greatest(probes, corpus, "id", "id", "tag").collect()}
    assert best == pytest.approx({(p, t): max(s for (q, h), s in want.items() if q == p and tags[h] == t) for p, _ in want for t in "xyz"})


def test_search_cuts_ties_within_a_block(spark):
    """A vector with many copies: each probe keeps k of them from each block, not all."""
    corpus = rows(spark, np.repeat(unit(1), 90, axis=0))
    made = knn.top(np.ones((90, 90)), 5)
    assert len(made[0]) == 450 and set(made[1]) == set(range(5))
    assert [r.hit for r in knn.nearest(corpus.where("id = 'r001'"), corpus, 3, "id", "id", exclude_self=True).orderBy("rn").collect()] == ["r000", "r002", "r003"]


@pytest.mark.parametrize("name", ["r06_loo_residual", "r07_corpus_prior", "r08_baselines", "r09_measure", "g12_channel_holes"])
def test_vectors_reach_python_as_arrow_columns(spark, sf, name):
    text = plan(spark, sf, name)
    assert "MapInArrow" in text and "MapInPandas" not in text


def test_v08_scores_batches_as_joins_do(spark):
    texts = ["Apple pie, apple tart", "pie", None, "", "tart tart tart tart", "nothing here", "pie", "APPLEKey pie2 pie"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple pie"), (2, "tart, tart"), (2, "key pie"), (3, None), (4, "absent")], "item_id long, q string")
    score = lambda f: [(r.item_id, r.doc_id, round(r.score, 9), r.rn) for r in f(docs, asked, "doc_id", "text", "item_id", "q", 3).orderBy("item_id", "rn").collect()]
    assert score(bm25.search) == score(bm25.search_by_joins) and len(score(bm25.search)) == 6
    assert "Generate" not in bm25.search(docs, asked, "doc_id", "text", "item_id", "q")._jdf.queryExecution().optimizedPlan().toString()


def test_j13_events_of_several_users(spark, sf):
    """Pairs are made distinct before the join, apart from events that stand under several users."""
    signals = spark.createDataFrame([(1, "u", "e"), (1, "u", "e"), (2, "u", "e"), (2, "w", "e"), (3, None, "e")], "seq long, user_id string, episode_id string")
    support = spark.createDataFrame([("c", "u", "e"), ("c", "u", "e"), ("c", "w", "e"), ("d", "w", "e"), ("d", "w", "f")], "claim_id string, user_id string, episode_id string")
    made = relational.signal_claims(signals, support)
    assert sorted((r.seq, r.claim_id) for r in made.collect()) == [(1, "c"), (2, "c"), (2, "d")]
    assert plan(spark, sf, "j13_signal_claims").startswith("Union")
