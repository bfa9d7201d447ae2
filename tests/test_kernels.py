"""Kernels on planted structure."""

import numpy as np
import pytest

from mnemoloom.operators import kernels as K

RNG = np.random.default_rng(7)
AXES = np.linalg.qr(RNG.normal(size=(48, 48)))[0].T


def near(axis, n, noise=0.04):
    v = AXES[axis] + noise * RNG.normal(size=(n, 48))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_residual_is_low_inside_and_high_outside():
    pool = near(0, 8)
    assert K.residual(near(0, 1)[0], pool) < 0.5 < 0.9 < K.residual(near(1, 1)[0], pool)
    assert K.residual(pool[0], np.zeros((0, 48))) == 1.0


@pytest.mark.parametrize("n", [2, 5, 6, 7, 10, 12, 13, 20])
def test_leave_one_out_is_strict_at_every_pool_size(n):
    rows = np.eye(48)[:n]
    assert all(K.loo_residual(i, rows) == pytest.approx(1.0) for i in range(n))


def test_measure_tells_known_from_new():
    pool = np.vstack([near(0, 8), near(1, 8)])
    clusters = ["a"] * 8 + ["b"] * 8
    base, prior = K.baselines(pool, clusters)
    ids = [f"m{i}" for i in range(16)]
    known = K.measure(near(0, 1, 0.005)[0], pool, ids, clusters, base, prior)
    new = K.measure(near(2, 1)[0], pool, ids, clusters, base, prior)
    assert known["z"] < new["z"] and known["cluster"] == "a" and not new["cold"]
    assert K.measure(pool[0], pool[:1], ["x"], ["a"], {}, prior)["cold"]


def test_assemble_never_repeats_and_shares_sum_to_one():
    cand = np.vstack([near(i, 3) for i in range(6)])
    chosen, gains, shares, _ = K.assemble(cand, np.ones(len(cand)), near(7, 1), k=6)
    assert len(set(chosen)) == len(chosen) <= 6 and sum(shares) == pytest.approx(1.0)
    assert len({c // 3 for c in chosen}) == len(chosen)


def test_bimodal_and_medoid():
    assert K.bimodal(np.vstack([near(0, 4), near(1, 4)])) and not K.bimodal(near(0, 8)) and not K.bimodal(near(0, 3))
    rows = near(0, 5)
    assert K.medoid(rows) == int(np.argmax((rows @ rows.T).sum(axis=1)))
