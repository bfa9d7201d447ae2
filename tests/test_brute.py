"""Queries that SQL can't express, against plain numpy and Python over the same tables."""

import collections
import json

import numpy as np
import pytest

from mnemoloom.functions import text as T
from mnemoloom.operators import kernels as K
from mnemoloom.operators import knn, log
from mnemoloom.operators import predictor as P
from mnemoloom.plans import events, graphs, registry
from mnemoloom.sources import embedder, memory


@pytest.fixture(scope="module")
def t(spark, sf):
    return lambda name: memory.load(spark, sf, name)


@pytest.fixture(scope="module")
def run(spark, sf):
    return lambda name: [r.asDict() for r in registry.queries()[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def claims(t):
    rows = t("claims").select("user_id", "claim_id", "concept_id", "vec_id", "embedding").collect()
    return {r.claim_id: (r.user_id, r.concept_id, np.array(r.embedding, dtype=float), r.vec_id) for r in rows}


def res(x, pool):
    """Residual against the six nearest rows, by the normal equations of a weighted ridge."""
    if not len(pool):
        return 1.0
    s = pool @ x
    near = sorted(range(len(pool)), key=lambda i: (-s[i], i))[:6]
    a, w = pool[near], np.maximum(s[near], 1e-3)
    p = a.T @ np.linalg.solve(a @ a.T + 0.05 * np.diag(w**-2), a @ x)
    return float(np.sqrt(max(0.0, 1 - min(np.linalg.norm(p), 1.0) ** 2)))


def loo(rows):
    """id -> residual against the other rows; ``rows``: id -> vector."""
    return {i: res(x, np.array([y for j, y in sorted(rows.items()) if j != i]).reshape(-1, len(x))) for i, x in rows.items()}


def grouped(claims, *by):
    out = collections.defaultdict(dict)
    for c, row in claims.items():
        out[tuple(row[b] for b in by)][c] = row[2]
    return out


@pytest.fixture(scope="module")
def baselines(claims):
    """(base by (user, concept), prior by user)."""
    base, prior = {}, {}
    own = {k: list(loo(v).values()) for k, v in grouped(claims, 0, 1).items() if len(v) >= 2}
    for (user,), _ in grouped(claims, 0).items():
        m = [np.mean(r) for k, r in own.items() if k[0] == user]
        s = [max(np.std(r), 0.03) for k, r in own.items() if k[0] == user]
        prior[user] = (np.mean(m), max(np.mean(s), 0.03))
    for k, r in own.items():
        w = len(r) / (len(r) + 4)
        base[k] = (w * np.mean(r) + (1 - w) * prior[k[0]][0], w * max(np.std(r), 0.03) + (1 - w) * prior[k[0]][1])
    return base, prior


def measured(claim, claims, baselines):
    user, _, x, _ = claims[claim]
    rest = sorted((c, r) for c, r in claims.items() if r[0] == user and c != claim)
    sims = sorted(((-round(float(r[2] @ x), 9), c) for c, r in rest))[:12]
    near = [(c, claims[c], -s) for s, c in sims]
    told = [(baselines[0][user, r[1]], max(float(r[2] @ x), 0)) for _, r, _ in near if (user, r[1]) in baselines[0]]
    w = np.array([v for _, v in told]) / sum(v for _, v in told)
    mu, sd = sum(a * b[0] for a, (b, _) in zip(w, told)), sum(a * b[1] for a, (b, _) in zip(w, told))
    n, prior = len(told), baselines[1][user]
    mu, sd = (n * mu + 8 * prior[0]) / (n + 8), max((n * sd + 8 * prior[1]) / (n + 8), 0.03)
    v = np.array([r[2] for _, r, _ in near])
    g = v @ v.T
    np.fill_diagonal(g, -9)
    r = res(x, v)
    votes = collections.Counter()
    for _, row, _ in near:
        votes[row[1]] += max(float(row[2] @ x), 0)
    return {"residual": r, "z": (r - mu) / sd, "nearest_sim": near[0][2], "anchor": near[0][0], "peer_mean": g.max(axis=1).mean(), "peer_std": g.max(axis=1).std(), "cluster": max(votes, key=lambda c: (votes[c], c))}


def close(got, want, places=4):
    assert got == pytest.approx(want, abs=0.6 * 10**-places)


def test_residuals(run, claims):
    for name, by in (("r03_residual", (0,)), ("r06_loo_residual", (0, 1))):
        want = {c: r for rows in grouped(claims, *by).values() for c, r in loo(rows).items()}
        got = {r["id"]: r["residual"] for r in run(name)}
        assert got.keys() == want.keys()
        for c in want:
            close(got[c], want[c])


def test_baselines(run, baselines):
    assert len(got := run("r08_baselines")) == len(baselines[0])
    for r in got:
        close((r["mu"], r["sd"]), baselines[0][r["user_id"], r["cluster"]])
    for r in run("r07_corpus_prior"):
        close((r["prior_mu"], r["prior_sd"]), baselines[1][r["user_id"]])


def test_measures_and_what_follows(run, claims, baselines):
    asked = [c for c, r in claims.items() if r[3] % 20 == 0]
    want = {c: measured(c, claims, baselines) for c in asked}
    got = {r["id"]: r for r in run("r09_measure")}
    assert got.keys() == want.keys()
    for c, m in want.items():
        close([got[c][k] for k in ("residual", "nearest_sim", "peer_mean", "peer_std")], [m[k] for k in ("residual", "nearest_sim", "peer_mean", "peer_std")])
        close(got[c]["z"], m["z"], 3)
        assert got[c]["anchor"] == m["anchor"] and got[c]["cluster"] == m["cluster"]

    def kind(m, z_echo):
        return "PREDICTED" if m["z"] <= z_echo else "AMBIGUOUS" if m["nearest_sim"] >= m["peer_mean"] - m["peer_std"] else "NOVEL"

    assert {r["id"]: r["route"] for r in run("r13_prediction_error")} == {c: kind(m, -3.5) for c, m in want.items()}
    assert {r["id"] for r in run("k05_integrity")} == {c for c, m in want.items() if kind(m, -3.5) == "NOVEL"}
    names = {"PREDICTED": "same", "AMBIGUOUS": "uncertain", "NOVEL": "new"}
    assert {r["id"]: r["decision"] for r in run("k01_dedup_route")} == {c: names[kind(m, 1.0)] for c, m in want.items()}


def test_dedup_bands_of_small_users(spark):
    v = lambda *x: (np.array(x) / np.linalg.norm(x)).tolist()
    rows = [("u", "a", v(1, 0, 0), None), ("u", "b", v(0, 1, 0), None)]
    corpus = spark.createDataFrame(rows, "user_id string, id string, embedding array<double>, cluster string")
    probes = spark.createDataFrame([("u", "p", v(1, 0.1, 0)), ("u", "q", v(1, 0.6, 0)), ("u", "r", v(0, 0, 1)), ("w", "s", v(0, 0, 1))], "user_id string, id string, embedding array<double>")
    assert {r.id: r.decision for r in P.dedup_route(probes, corpus).collect()} == {"p": "same", "q": "uncertain", "r": "new", "s": "new"}


def test_notes_are_routed_causally(run, claims):
    want = {}
    for (user,), _ in grouped(claims, 0).items():
        pool, ids, clusters = [], [], []
        for c, row in sorted(((c, r) for c, r in claims.items() if r[0] == user), key=lambda x: x[1][3]):
            m = K.measure(row[2], np.array(pool).reshape(len(pool), 64), ids, clusters, {}, (0.7, 0.2))
            near = m["peer_mean"] == m["peer_std"] == 0 or (m["nearest_sim"] or 0) >= m["peer_mean"] - m["peer_std"]
            kind = "NOVEL" if m["cold"] else "PREDICTED" if m["z"] <= -3.5 else "AMBIGUOUS" if near else "NOVEL"
            region = c if kind == "NOVEL" else clusters[ids.index(m["anchor"])]
            want[c] = (kind, region)
            if kind != "PREDICTED":
                pool.append(row[2])
                ids.append(c)
                clusters.append(region)
    assert {r["id"]: (r["route"], r["cluster"]) for r in run("g13_route_note")} == want


def test_channel_holes(run, claims):
    groups = grouped(claims, 0, 1)
    centre = {k: np.mean(list(v.values()), axis=0) for k, v in groups.items() if len(v) >= 2}
    centre = {k: c / np.linalg.norm(c) for k, c in centre.items()}
    spread = {k: (0.7, 0.2) if len(v) <= 7 else (np.mean(r := list(loo(v).values())), max(np.std(r), 0.03)) for k, v in groups.items() if len(v) >= 2}
    best = []
    for c, (user, home, x, _) in claims.items():
        near = sorted(((-round(float(v @ x), 9), k[1], k) for k, v in centre.items() if k[0] == user and k[1] != home))[:10]
        found = []
        for s, name, k in near:
            z = (res(x, np.array([y for _, y in sorted(groups[k].items())])) - spread[k][0]) / spread[k][1]
            if -s >= 0.2 and 1 <= z <= 3:
                found.append((round(-s * z, 6), name, z))
        if found:
            s, name, z = min(found, key=lambda f: (-f[0], f[1]))
            best.append((user, c, name, s, z))
    got = run("g12_channel_holes")
    want = {(u, c): (name, z) for u in {b[0] for b in best} for _, c, name, _, z in sorted((b for b in best if b[0] == u), key=lambda b: (-b[3], b[1]))[:80]}
    assert got and {(r["user_id"], r["claim_id"]) for r in got} == want.keys()
    for r in got:
        assert r["channel"] == want[r["user_id"], r["claim_id"]][0]
        close(r["z"], want[r["user_id"], r["claim_id"]][1], 3)


def test_query_decomposition(spark, t, run):
    rows = t("conversations").where("role = 'user'").selectExpr("concat_ws(':', conv_id, turn) id", "text").distinct()
    parts = {r.id: list(r.s) for r in rows.select("id", T.sentences(rows["text"], 1).alias("s")).collect()}
    want = {}
    for i, sentences in parts.items():
        v = [np.array(embedder.embed_text(s), dtype=np.float32).astype(float) for s in sentences]
        sims = [max(float(v[j] @ v[k]) for j in range(k)) for k in range(2, len(v))]
        cuts = set()
        if len(sims) >= 2:
            m = np.median(sims)
            sd = max(0.06, 1.4826 * np.median(np.abs(np.array(sims) - m)))
            cuts = {k + 2 for k, s in enumerate(sims) if (s - m) / sd <= -1.5}
        groups = []
        for k, s in enumerate(sentences):
            if not groups or k in cuts or not cuts:
                groups.append([])
            groups[-1].append(s)
        want[i] = [" ".join(g) for g in groups]
    got = collections.defaultdict(list)
    for r in sorted(run("sg06_decompose_query"), key=lambda r: (r["turn_id"], r["part"])):
        got[r["turn_id"]].append(r["text"])
    assert dict(got) == {i: g for i, g in want.items() if g}


def spread(seeds, edges, vectors):
    lit = collections.defaultdict(float)
    for q, node, p, v in seeds:
        lit[q, node, p] = max(lit[q, node, p], v)
    front = dict(lit)
    for _ in range(2):
        glow = collections.defaultdict(lambda: collections.defaultdict(float))
        for (q, node, _), v in lit.items():
            glow[q][node] = max(glow[q][node], v)
        pools = {q: np.array([vectors[n] for n in sorted(g) if g[n] >= 0.10 and n in vectors]) for q, g in glow.items()}
        new, memo = collections.defaultdict(float), {}
        for (q, node, p), v in front.items():
            for dst, w, degree in edges.get(node, []):
                if (q, dst) not in memo:
                    memo[q, dst] = res(np.array(vectors[dst]), pools[q]) if dst in vectors and len(pools[q]) >= 2 else 1.0
                new[q, dst, p] = max(new[q, dst, p], v * w * memo[q, dst] / degree**0.5)
        front = {k: v for k, v in new.items() if v >= 0.04 and v > lit.get(k, 0)}
        total, gain = sum(lit.values()), sum(front.values())
        lit.update(front)
        if gain < 0.05 * total:
            break
    return lit


def test_spreading_with_the_residual_condition(t, run):
    seeds = [(r["query"], r["node"], r["probe"], r["value"]) for r in run("gr02_seeds")]
    edges = collections.defaultdict(list)
    for r in graphs.edges(t).collect():
        edges[r.src].append((r.dst, r.w, r.degree))
    vectors = {r.node: r.v for r in graphs.node_vectors(t).collect()}
    want = spread(seeds, edges, vectors)
    got = {(r["query"], r["node"], r["probe"]): r["value"] for r in run("gr03_spread")}
    assert got.keys() == want.keys() and got == pytest.approx(dict(want), abs=1e-6)


def replay(rows):
    """Naive state of one user's events: plain dictionaries, one branch for each type."""
    s = collections.defaultdict(dict)
    mem, claim, rel, frag, qry = s["m"], s["c"], s["r"], s["f"], s["q"]

    def put(k, c, kind="primary"):
        if kind == "primary":
            mem[k][c] = kind
        else:
            mem[k].setdefault(c, kind)

    for kind, p in rows:
        k, c = p.get("concept_id"), p.get("claim_id")
        if kind == "CANONICALIZED":
            if p["action"] == "new":
                claim.setdefault(c, [1.0, 0, None])
            elif c in claim:
                claim[c][0] += 0.5
        elif kind == "STRENGTHENED" and c in claim:
            claim[c][0] += p["delta"]
        elif kind in ("BACKGROUNDED", "UNBACKGROUNDED") and c in claim:
            claim[c][1] = int(kind[0] == "B")
        elif kind == "VERSIONED":
            for end, word in (("current_id", "current"), ("other_id", "superseded")):
                if p[end] in claim:
                    claim[p[end]][2] = (p["version_group"], word)
        elif kind == "CONCEPT_CREATED" or kind == "SPLIT":
            if kind == "SPLIT":
                mem.pop(k, None)
            for child in p["into"] if kind == "SPLIT" else [p]:
                mem.setdefault(child["concept_id"], {})
                s["l"].setdefault(child["concept_id"], child.get("label", ""))
                s["s"].setdefault(child["concept_id"], "active")
                for x in child["claim_ids"]:
                    put(child["concept_id"], x)
        elif kind == "ATTACHED" and k in mem:
            for x in p["claim_ids"]:
                put(k, x)
        elif kind == "MERGED" and p["winner_id"] in mem:
            for x in list(mem.get(p["loser_id"], {})):
                put(p["winner_id"], x)
            mem.pop(p["loser_id"], None)
        elif kind == "RELATED":
            rel[p["from_id"], p["to_id"], p["relation"]] = p["weight"]
        elif kind == "DECAYED" and k in mem:
            s["s"][k] = p["state_to"]
        elif kind == "PRUNED":
            mem.get(k, {}).pop(c, None)
            if all(h.get(c) != "primary" for h in mem.values()):
                claim.pop(c, None)
        elif kind in ("CHANNEL_REDUNDANCY", "QUERY_INJECTED"):
            mine = "redundant" if kind[0] == "C" else "query"
            for h in mem.values():
                for x in [x for x in h if h[x] == mine]:
                    del h[x]
            pairs = p["pairs"] if kind[0] == "C" else {q["id"]: q["concept_ids"] for q in p["queries"]}
            for x, ks in pairs.items():
                for y in ks:
                    if y in mem:
                        put(y, x, mine)
            if kind[0] == "Q":
                qry.clear()
                qry.update({q["id"]: q["text"] for q in p["queries"]})
        elif kind == "FRAGMENTED":
            for f in p["fragments"]:
                frag.setdefault(f["frag_id"], [f["cluster"], 1.0])
            for f in p["reinforced"]:
                if f in frag:
                    frag[f][1] += 0.25
        elif kind == "RECLUSTERED":
            for f, y in p["assignments"].items():
                if f in frag:
                    frag[f][0] = y
    out = {("concept", k, s["s"][k], float(len(h)), s["l"][k]) for k, h in mem.items()} | {("member", k, c, None, kind) for k, h in mem.items() for c, kind in h.items()}
    out |= {("claim", c, v[0] if v else None, x, ",".join(filter(None, ["background" if b else "", v and v[1]]))) for c, (x, b, v) in claim.items()}
    return out | {("relation", a, b, w, r) for (a, b, r), w in rel.items()} | {("fragment", f, k, x, None) for f, (k, x) in frag.items()} | {("query", q, None, None, x) for q, x in qry.items()}


def test_replay_of_every_event_type(t, run):
    back = {r.run_id for r in t("runs").where("status = 'rolled_back'").collect()}
    by_user = collections.defaultdict(list)
    for r in sorted(events.full_log(t).collect(), key=lambda r: r.seq):
        if r.run_id not in back:
            by_user[r.user_id].append((r.type, json.loads(r.payload)))
    want = {(u, *row) for u, rows in by_user.items() for row in replay(rows)}
    none = lambda x: None if x is None or x != x else x
    got = {(r["user_id"], r["entity"], r["id"], r["ref"], none(r["value"]), r["detail"]) for r in run("k11_replay_all")}
    assert got == want and {r[1] for r in got} == {"concept", "member", "claim", "relation", "fragment", "query"}


@pytest.mark.parametrize("name, extra", [("k12_rebuild_fold", set()), ("k13_rollback_rebuild", {"run_3"})])
def test_rebuild_of_members(t, run, name, extra):
    back = {r.run_id for r in t("runs").where("status = 'rolled_back'").collect()} | extra
    state = collections.defaultdict(log.Memory)
    for r in sorted(events.concept_log(t).collect(), key=lambda r: r.seq):
        if r.run_id not in back:
            state[r.user_id].apply(r.type, json.loads(r.payload))
    want = {(u, *row) for u, s in state.items() for row in s.rows()}
    assert {(r["user_id"], r["concept_id"], r["label"], r["state"], r["claim_id"], r["kind"]) for r in run(name)} == want


def test_steps_by_group(run, claims):
    """What one concept's rows give, from the kernels called on each group in turn."""
    for (user, concept), rows in grouped(claims, 0, 1).items():
        ids, v = sorted(rows), np.array([rows[i] for i in sorted(rows)])
        mine = lambda name: [r for r in seen(name) if (r.get("user_id"), r.get("cluster", r.get("fragment"))) == (user, concept)]
        seen = lambda name: cache.setdefault(name, run(name)) if (cache := test_steps_by_group.__dict__.setdefault("cache", {})) is not None else None
        assert {r["id"]: r["droppable"] for r in mine("g02_safe_forget")} == dict(zip(ids, K.droppable(v)))
        assert mine("g08_bimodality")[0]["bimodal"] == K.bimodal(v)
        total = v @ v.sum(axis=0)
        assert mine("g09_concept_geometry")[0]["medoid"] == mine("x02_representatives")[0]["medoid"] == ids[int(np.argmax(np.round(total, 12)))]
        r = {i: res(rows[i], np.array([rows[j] for j in ids if j != i])) for i in ids}
        close(mine("g07_fragment_medoid")[0]["residual"], min(r.values()))
        for row in mine("r05_residual_direction"):
            d = K.residual_direction(rows[row["id"]], np.array([rows[j] for j in ids if j != row["id"]]))
            close(row["first"], d[0])
        number = (int(concept.rsplit("_", 1)[1]) - 1) % 10
        other = grouped(claims, 0, 1)[user, f"{concept.rsplit('_', 1)[0]}_{number}"]
        pool = np.array([other[j] for j in sorted(other)])
        for row in mine("g04_merge_residual"):
            close(row["residual"], res(rows[row["id"]], pool))


def test_assembled_sets_come_from_candidates(run, claims):
    """Greedy choice: every step's gain is the residual against the query and what was chosen before."""
    for name in ("g01_assemble", "b08_fragment_recall", "b07_resonance_recall"):
        by_query = collections.defaultdict(list)
        for r in run(name):
            by_query[r["query"]].append(r)
        assert by_query
        for q, rows in by_query.items():
            vec = claims.get(q, claims[f"clm_{int(q[1:]) * 40}"] if q[0] == "q" else None)[2]
            have = [vec]
            for r in sorted(rows, key=lambda r: r["rank"]):
                x = claims["clm_" + r["id"].split("_")[1]][2]
                close(r["gain"], 1.0 if len(have) < 2 else res(x, np.array(have)), 6)
                have.append(x)
            assert sum(r["share"] for r in rows) == pytest.approx(1.0) and len({r["id"] for r in rows}) == len(rows)


def test_background_concepts(run, claims):
    groups = grouped(claims, 0, 1)
    mean = {k: np.mean(list(v.values()), axis=0) for k, v in groups.items()}
    want = set()
    for c, (user, _, x, n) in claims.items():
        if n % 20 == 0:
            near = sorted(((-float(m @ x) / np.linalg.norm(m), k[1]) for k, m in mean.items() if k[0] == user))
            want |= {(c, name) for s, name in near[:3] if -s >= 0.18}
    assert {(r["query"], r["concept_id"]) for r in run("b09_background_concepts")} == want


def test_kmeans_groups_planted_clusters(run):
    rng = np.random.default_rng(1)
    rows = np.vstack([np.eye(6)[i] + 0.01 * rng.normal(size=(5, 6)) for i in range(3)])
    got = K.kmeans(rows, 3)
    assert all(len(set(got[i * 5 : i * 5 + 5])) == 1 for i in range(3)) and len(set(got)) == 3
    assert len({r["id"] for r in run("g18_kmeans_fallback")}) == len(run("g18_kmeans_fallback"))


# block pairs of the search


def test_hot_users_spread_and_small_ones_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 100)
    vec = "array(cast(sin(id) as float), cast(cos(id) as float)) embedding"
    hot = spark.range(2000).selectExpr("'hot' user_id", "concat('h', id) id", vec)
    tiny = spark.range(10000).selectExpr("concat('u', id) user_id", "concat('t', id) id", vec)
    both = hot.unionByName(tiny)
    pairs = knn.block_pairs(both, both, "id", "id", "embedding", "user_id")
    of_hot = pairs.where("user = 'hot'").select("pb", "cb").distinct().count()
    assert of_hot == 400 and pairs.where("user <> 'hot'").count() == 10000
    got = {r.probe: (r.hit, r.sim) for r in knn.nearest(hot.where("id in ('h7', 'h1999')"), hot, 1, "id", "id", exclude_self=True).collect()}
    v = np.array([[np.sin(i), np.cos(i)] for i in range(2000)], dtype=np.float32).astype(float)
    for i in (7, 1999):
        s = v @ v[i]
        s[i] = -9
        assert got[f"h{i}"][1] == pytest.approx(s.max())
