"""Numeric kernels of the predictor, for use inside grouped functions. All take unit row vectors.

The residual of x against a pool is what the span of its nearest rows leaves unexplained. Leave-one-out is strict here: the
row itself is taken out of the pool before neighbours are searched, whatever the pool's size.
"""

from __future__ import annotations

import numpy as np

SPAN, STAT, SHRINK, GRADUATION, SD_FLOOR, RIDGE = 6, 12, 8.0, 4.0, 0.03, 0.05


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` greatest scores, ties by place."""
    return np.lexsort((np.arange(len(scores)), -scores))[:k]


def project(x: np.ndarray, span: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge projection of ``x`` on the rows of ``span``; rows of little weight are held back."""
    w = np.clip(weight, 1e-3, None)
    a = np.linalg.solve(span @ span.T + RIDGE * np.diag(1.0 / w**2), span @ x)
    return span.T @ a


def _explained(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    s = pool @ x
    near = top(s, SPAN)
    return project(x, pool[near], s[near])


def residual(x: np.ndarray, pool: np.ndarray) -> float:
    if not len(pool):
        return 1.0
    p = min(float(np.linalg.norm(_explained(x, pool))), 1.0)
    return float(np.sqrt(max(0.0, 1.0 - p * p)))


def residuals(x: np.ndarray, pools: np.ndarray) -> np.ndarray:
    """``residual`` of each row of ``x`` against its own pool (n, m, d), or all against one (m, d), in one call."""
    pools = np.broadcast_to(pools, (len(x), *pools.shape[-2:]))
    if not pools.shape[1] or not len(x):
        return np.ones(len(x))
    s = (pools @ x[:, :, None])[:, :, 0]
    near = np.argsort(-s, axis=1, kind="stable")[:, :SPAN]
    span = np.take_along_axis(pools, near[:, :, None], 1)
    return _left(np.take_along_axis(s, near, 1), span @ span.transpose(0, 2, 1))


def _unexplained(gram: np.ndarray, x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """``residual`` of rows ``x`` against rows ``pool``, both by their places in the table of all dot products."""
    s = gram[np.ix_(x, pool)]
    near = np.argsort(-s, axis=1, kind="stable")[:, :SPAN]
    span = pool[near]
    return _left(np.take_along_axis(s, near, 1), gram[span[:, :, None], span[:, None, :]])


def _left(s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What ridge projections leave, by each row's dot products with its span (n, m) and the span's own (n, m, m)."""
    ridge, i = g.copy(), np.arange(s.shape[1])
    ridge[:, i, i] += RIDGE / np.clip(s, 1e-3, None) ** 2
    a = np.linalg.solve(ridge, s[:, :, None])
    p = (a.transpose(0, 2, 1) @ g @ a)[:, 0, 0]
    return np.sqrt(np.clip(1.0 - p, 0.0, 1.0))


def residual_direction(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    d = x - _explained(x, pool) if len(pool) else x.copy()
    n = np.linalg.norm(d)
    return d / n if n > 1e-9 else np.zeros_like(d)


def loo_residual(i: int, pool: np.ndarray) -> float:
    """Residual of row ``i`` against its ``STAT`` nearest other rows."""
    others = np.delete(pool, i, axis=0)
    if not len(others):
        return 1.0
    return residual(pool[i], others[top(others @ pool[i], STAT)])


def sampled(n: int, sample: int = 64, seed: int = 0) -> np.ndarray:
    """The rows of ``n`` whose leave-one-out residuals make the prior: ``sample`` where there are more, as the measure prescribes."""
    return np.arange(n) if n <= sample else np.sort(np.random.default_rng(seed).choice(n, sample, replace=False))


def corpus_prior(pool: np.ndarray, sample: int = 64, seed: int = 0) -> tuple[float, float]:
    """Mean and spread of the leave-one-out residuals of ``sampled`` rows."""
    if len(pool) <= SPAN:
        return 0.7, 0.2
    r = np.array([loo_residual(i, pool) for i in sampled(len(pool), sample, seed)])
    return float(r.mean()), max(float(r.std()), SD_FLOOR)


def baselines(pool: np.ndarray, clusters: list) -> tuple[dict, tuple[float, float]]:
    """({cluster: (mean, spread)}, prior): clusters of two or more rows, shrunk towards the prior by their size."""
    own: dict = {}
    for c in sorted({c for c in clusters if c is not None}):
        rows = pool[[i for i, x in enumerate(clusters) if x == c]]
        if len(rows) >= 2:
            r = np.array([loo_residual(i, rows) for i in range(len(rows))])
            own[c] = (float(r.mean()), max(float(r.std()), SD_FLOOR), len(rows))
    prior = (float(np.mean([m for m, _, _ in own.values()])), max(float(np.mean([s for _, s, _ in own.values()])), SD_FLOOR)) if len(own) >= 2 else corpus_prior(pool)
    shrunk = {}
    for c, (m, s, n) in own.items():
        w = n / (n + GRADUATION)
        shrunk[c] = (w * m + (1 - w) * prior[0], w * s + (1 - w) * prior[1])
    return shrunk, prior


def measure(x: np.ndarray, pool: np.ndarray, ids: list, clusters: list, base: dict, prior: tuple[float, float], exclude: int | None = None) -> dict:
    """Residual, z, nearest similarity, anchor, peer statistics and leading cluster of ``x`` against a corpus."""
    keep = [i for i in range(len(pool)) if i != exclude]
    if len(keep) < 2:
        return {"residual": 1.0, "z": 0.0, "nearest_sim": None, "anchor": None, "peer_mean": 0.0, "peer_std": 0.0, "cluster": None, "cold": True}
    rest, s = pool[keep], pool[keep] @ x
    near = top(s, STAT)
    r = residual(x, rest)
    told = [(base[clusters[keep[j]]], max(float(s[j]), 0.0)) for j in near if clusters[keep[j]] in base]
    if told:
        w = np.array([v for _, v in told])
        w = w / w.sum() if w.sum() > 0 else np.full(len(told), 1 / len(told))
        mu, sd, n = float(sum(a * b[0] for a, (b, _) in zip(w, told))), float(sum(a * b[1] for a, (b, _) in zip(w, told))), len(told)
    else:
        held = rest[near]
        mutual = residuals(held, np.array([np.delete(held, i, axis=0) for i in range(len(held))]))
        mu, sd, n = float(mutual.mean()), float(mutual.std()), len(near)
    mu, sd = (n * mu + SHRINK * prior[0]) / (n + SHRINK), max((n * sd + SHRINK * prior[1]) / (n + SHRINK), SD_FLOOR)
    peers = rest[near] @ rest[near].T
    np.fill_diagonal(peers, -np.inf)
    best = peers.max(axis=1) if len(near) >= 2 else np.zeros(0)
    votes: dict = {}
    for j in near:
        if (c := clusters[keep[j]]) is not None:
            votes[c] = votes.get(c, 0.0) + max(float(s[j]), 0.0)
    lead = min(votes, key=lambda c: (-votes[c], c)) if votes else None
    return {
        "residual": r, "z": (r - mu) / sd, "nearest_sim": float(s[near[0]]), "anchor": ids[keep[near[0]]], "cluster": lead, "cold": False,
        "peer_mean": float(best.mean()) if len(best) else 0.0, "peer_std": float(best.std()) if len(best) else 0.0,
    }


def medoid(rows: np.ndarray) -> int:
    """The row with the greatest sum of cosines to all, the first of equals."""
    return int(np.argmax(np.round(rows @ rows.sum(axis=0), 12)))


def bimodal(rows: np.ndarray, margin: float = 0.15) -> bool:
    """Whether the rows fall apart into two sides of two or more that are closer within than across."""
    if len(rows) < 4:
        return False
    g = rows @ rows.T
    a, b = np.unravel_index(np.argmin(g), g.shape)
    side = g[:, a] >= g[:, b]
    if side.sum() < 2 or (~side).sum() < 2:
        return False

    def within(m):
        h = g[np.ix_(m, m)]
        return (h.sum() - np.trace(h)) / (len(h) * (len(h) - 1))

    return bool((within(side) + within(~side)) / 2 - g[np.ix_(side, ~side)].mean() > margin)


def assemble(cand: np.ndarray, weight: np.ndarray, seed: np.ndarray, k: int = 6, gain_floor: float = 0.35, value_floor: float | None = None) -> tuple[list, list, list, str]:
    """Greedy choice by residual times weight: (chosen, gains, shares, why it stopped)."""
    return greedy(cand, weight, seed, k, gain_floor, value_floor)[:4]


def greedy(cand: np.ndarray, weight: np.ndarray, seed: np.ndarray, k: int = 6, gain_floor: float = 0.35, value_floor: float | None = None) -> tuple[list, list, list, str, list]:
    """``assemble`` and the greatest value of each step, the one that it stopped at included."""
    chosen: list[int] = []
    gains: list[float] = []
    values: list[float] = []
    rows = np.vstack([cand, seed]) if len(seed) else cand
    gram, have = rows @ rows.T, list(range(len(cand), len(rows)))
    why = "exhausted"
    while len(chosen) < len(cand):
        if len(chosen) >= k:
            why = "full"
            break
        left = np.setdiff1d(np.arange(len(cand)), chosen)
        r = np.ones(len(left)) if len(have) < 2 else _unexplained(gram, left, np.array(have))
        value = r * np.clip(weight[left], 0, None)
        at = int(np.argmax(np.round(value, 12)))
        values.append(float(value[at]))
        if r[at] < gain_floor or (value_floor is not None and value[at] < value_floor):
            why = "gain" if r[at] < gain_floor else "value"
            break
        chosen.append(int(left[at]))
        gains.append(float(r[at]))
        have.append(int(left[at]))
    total = sum(gains)
    return chosen, gains, [g / total if total else 0.0 for g in gains], why, values


def droppable(rows: np.ndarray, z_forget: float = -0.5) -> list[bool]:
    """Rows that the others explain so well that they can go."""
    if len(rows) < 3:
        return [False] * len(rows)
    prior = corpus_prior(rows)
    base = {0: prior}
    return [measure(rows[i], rows, list(range(len(rows))), [0] * len(rows), base, prior, exclude=i)["z"] <= z_forget for i in range(len(rows))]


def reanchor(own: np.ndarray, near: np.ndarray, lam: float = 1.0) -> int:
    """The member that tells its concept best from its neighbours: unexplained by them, explained by its own."""
    if not len(near) or len(own) < 2:
        return medoid(own)
    score = [residual(own[i], near) - lam * residual(own[i], np.delete(own, i, axis=0)) for i in range(len(own))]
    return int(np.argmax(np.round(score, 12)))


def kmeans(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """The cluster of each row: first centres spread out from the medoid, each next one farthest from those before."""
    k = min(k, len(rows))
    picked = [medoid(rows)]
    while len(picked) < k:
        far = ((rows[:, None] - rows[picked][None]) ** 2).sum(axis=2).min(axis=1)
        picked.append(int(np.argmax(np.round(far, 12))))
    centres, own = rows[picked], np.zeros(len(rows), dtype=int)
    for _ in range(rounds):
        new = np.argmin(np.round(((rows[:, None] - centres[None]) ** 2).sum(axis=2), 12), axis=1)
        if _ and (new == own).all():
            break
        own = new
        centres = np.array([rows[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    return own
