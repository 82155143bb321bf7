"""Balanced assignments, low-rank soft partitions and singular vectors against dense NumPy."""

import math

import numpy as np
import pytest

from quern.functions.stages import cut
from quern.operators import attention, balanced, low_rank, svd
from quern.operators.balanced import softmax
from quern.operators.soft import objective_and_gradient

rng = np.random.default_rng(21)
N, D, C, M = 45, 3, 2, 4
X = rng.normal(size=(N, D))
X = (X - X.mean(0)) / np.sqrt(((X - X.mean(0)) ** 2).sum(1).mean())
Q = softmax(rng.normal(size=(N, C)))
LOGITS = rng.normal(size=(N, M)) * 1.5
A = np.concatenate((np.ones((N, 1)), X, Q), 1)


def frame(spark, **columns):
    shape = ", ".join(f"{k} {'array<double>' if np.ndim(v) == 2 else 'int'}" for k, v in columns.items())
    rows = [(i, *(v[i].tolist() for v in columns.values())) for i in range(len(next(iter(columns.values()))))]
    return cut(spark.createDataFrame(rows, f"id long, {shape}").repartition(4))


# balanced


def dense_duals(logits):
    dual = np.zeros(M)
    for _ in range(5000):
        mass = softmax(logits - dual).mean(0)
        dual += np.log(M * mass)
    return dual - dual.mean()


def dense_moments(logits):
    return softmax(logits - dense_duals(logits)).T @ A / N


def test_duals_equal_dense_ones_and_masses_are_even(spark):
    n = frame(spark, logits=LOGITS, a=A)
    dual, scans, error = balanced.balanced_duals(n, M, 1e-10)
    assert np.allclose(dual, dense_duals(LOGITS), atol=1e-8) and error <= 1e-10 and scans > 1
    assert np.allclose(balanced.masses(n, dual), 1 / M, atol=1e-10)
    assert np.allclose(balanced.balanced_moments(n, dual), dense_moments(LOGITS), atol=1e-8)
    # a start near the end needs fewer scans
    assert balanced.balanced_duals(n, M, 1e-10, start=dual)[1] == 1


def test_no_convergence_raises(spark):
    n = frame(spark, logits=LOGITS)
    with pytest.raises(RuntimeError, match="equal"):
        balanced.balanced_duals(n, M, 1e-12, most=2)
    with pytest.raises(FloatingPointError):
        balanced.balanced_duals(frame(spark, logits=np.tile([0.0, -1e6], (5, 1))), 2)
    with pytest.raises(ValueError, match="no nodes"):
        balanced.balanced_duals(n.limit(0), M)


@pytest.mark.parametrize("matrix_free", [False, True])
def test_gradient_through_the_duals_equals_finite_differences(spark, matrix_free):
    n = frame(spark, logits=LOGITS, a=A)
    target = rng.normal(size=(M, A.shape[1]))
    loss = lambda z: float((dense_moments(z) * target).sum() + 0.5 * (dense_moments(z) ** 2).sum())
    dual, _, _ = balanced.balanced_duals(n, M, 1e-12)
    slope = target + balanced.balanced_moments(n, dual)
    got = {r.id: np.array(r.g) for r in balanced.balanced_gradient(n, dual, slope, matrix_free).collect()}
    for i in (0, 17, 44):
        for j in range(M):
            z = LOGITS.copy()
            z[i, j] += 1e-5
            up = loss(z)
            z[i, j] -= 2e-5
            assert math.isclose(got[i][j], (up - loss(z)) / 2e-5, rel_tol=1e-4, abs_tol=1e-8)


# low rank


def dense_adam(u, v, extra, weight, steps, rate):
    energy, cross = (X**2).sum(1).mean(), X.T @ Q / N
    state, history = [np.zeros_like(u), np.zeros_like(u), np.zeros_like(v), np.zeros_like(v)], []
    r = math.sqrt(u.shape[1])
    for t in range(1, steps + 2):
        p = softmax(extra + u @ v.T / r)
        j, slope = objective_and_gradient(p.T @ A / N, energy, cross, weight)
        history.append(j)
        if t > steps:
            return history, u, v
        d = A @ slope.T / N
        block = p * (d - (p * d).sum(1, keepdims=True)) / r
        for k, (g, x) in enumerate(((block @ v, "u"), (block.T @ u, "v"))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
            move = rate * state[2 * k] / (1 - 0.9**t) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**t)) + 1e-8)
            if x == "u":
                fresh = u - move
            else:
                v = v - move
        u = fresh


@pytest.mark.parametrize("kind", ["none", "hard", "factors"])
def test_steps_equal_dense_adam(spark, kind):
    u, v, cell = rng.normal(size=(N, 3)), rng.normal(size=(M, 3)), np.arange(N) % M
    left, right = rng.normal(size=(N, 2)), rng.normal(size=(M, 2))
    base = {"none": low_rank.Base(), "hard": low_rank.hard_base(M, 0.3), "factors": low_rank.Base("factors", right=right)}[kind]
    extra = {"none": np.zeros((N, M)), "hard": base.bias * np.eye(M)[cell], "factors": left @ right.T}[kind]
    n = frame(spark, x=X, q=Q, u=u, cell=cell, left=left)
    found = low_rank.low_rank_partition(n, v, 2.0, steps=6, rate=0.05, base=base)
    history, uu, vv = dense_adam(u, v, extra, 2.0, 6, 0.05)
    assert np.allclose(found.history, history, atol=1e-10) and np.allclose(found.cells, vv, atol=1e-8)
    got = {r.id: r.u for r in found.nodes.collect()}
    assert np.allclose([got[i] for i in range(N)], uu, atol=1e-8)
    assert found.history[found.best_step] == min(found.history) <= found.history[0]
    assert math.isclose(found.mass.sum(), N) and np.allclose((found.mass[:, None] * found.centres).sum(0), X.sum(0), atol=1e-9)


def test_gradient_of_the_factors_equals_finite_differences(spark):
    u, v = rng.normal(size=(N, 2)), rng.normal(size=(M, 2))
    energy, cross = (X**2).sum(1).mean(), X.T @ Q / N

    def j(w):
        return objective_and_gradient(softmax(w @ v.T / math.sqrt(2)).T @ A / N, energy, cross, 1.5)[0]

    _, slope = objective_and_gradient(softmax(u @ v.T / math.sqrt(2)).T @ A / N, energy, cross, 1.5)
    got = {r.id: r.g for r in low_rank.node_gradient(frame(spark, x=X, q=Q, u=u), v, slope, N).collect()}
    for i in (0, 20):
        for k in range(2):
            w = u.copy()
            w[i, k] += 1e-6
            up = j(w)
            w[i, k] -= 2e-6
            assert math.isclose(got[i][k], (up - j(w)) / 2e-6, rel_tol=1e-4, abs_tol=1e-9)


def test_random_factors_do_not_depend_on_partitions(spark):
    n = frame(spark, x=X, q=Q)
    a, b = (low_rank.random_factors(n.repartition(k), M, 3, 4) for k in (1, 7))
    assert np.array_equal(a[1], b[1]) and {r.id: r.u for r in a[0].collect()} == {r.id: r.u for r in b[0].collect()}
    everything = np.array([r.u for r in a[0].collect()])
    assert abs(everything.mean()) < 0.3 and 0.7 < everything.std() < 1.3


def test_settings_out_of_range_raise(spark):
    n = frame(spark, x=X, q=Q, u=rng.normal(size=(N, 2)))
    for weight, steps, rate in ((0.0, 1, 0.1), (math.inf, 1, 0.1), (1.0, 1, 0.0), (1.0, -1, 0.1)):
        with pytest.raises(ValueError, match="must be"):
            low_rank.low_rank_partition(n, np.zeros((M, 2)), weight, steps, rate)


# singular vectors


def spoiled(n=200, d=6):
    """Singular values from 1 to 1e-9: their squares don't survive in a Gram matrix."""
    u, _ = np.linalg.qr(rng.normal(size=(n, d)))
    v, _ = np.linalg.qr(rng.normal(size=(d, d)))
    return u * 10.0 ** np.linspace(0, -9, d) @ v.T


def test_singular_values_survive_bad_conditions(spark):
    x = spoiled()
    s, axes = svd.right_vectors(frame(spark, x=x), 6)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s / want, 1, rtol=1e-5) and np.allclose(np.abs((axes * vt.T).sum(0)), 1, atol=1e-5)
    gram = np.sqrt(np.maximum(np.linalg.eigvalsh(x.T @ x)[::-1], 0))
    assert not np.allclose(gram / want, 1, rtol=1e-2)


def test_range_finder_finds_the_leading_axes_of_wide_rows(spark):
    x = rng.normal(size=(60, 40)) * 0.01
    x += rng.normal(size=(60, 3)) * [9, 5, 3] @ rng.normal(size=(3, 40))
    s, axes = svd.leading_axes(frame(spark, x=x), 3)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[:3], rtol=1e-8) and np.allclose(np.abs((axes * vt[:3].T).sum(0)), 1, atol=1e-7)


@pytest.mark.parametrize("rank", [1, 2, 4, 6])
def test_factors_are_the_best_of_their_rank(spark, rank):
    u, v = svd.svd_factors(frame(spark, logits=LOGITS), rank)
    got = {r.id: np.array(r.u) for r in u.collect()}
    made = np.array([got[i] for i in range(N)]) @ v.T / math.sqrt(rank)
    a, s, bt = np.linalg.svd(LOGITS, full_matrices=False)
    k = min(rank, M)
    assert v.shape == (M, rank) and np.allclose(made, a[:, :k] * s[:k] @ bt[:k], atol=1e-9)
    if rank <= M:
        assert np.allclose((v**2).sum(0), s[:rank] * math.sqrt(rank))


def test_factors_of_products_and_of_nothing(spark):
    right = rng.normal(size=(5, D))
    u, v = svd.svd_factors(frame(spark, x=X), 4, "x", right)
    got = {r.id: np.array(r.u) for r in u.collect()}
    assert np.allclose(np.array([got[i] for i in range(N)]) @ v.T / 2, X @ right.T, atol=1e-9)
    u, v = svd.svd_factors(frame(spark, x=np.zeros((5, 3))), 2, "x")
    assert not v.any() and all(not any(r.u) for r in u.collect())


def test_distance_factors_stand_for_the_nearest_centre(spark):
    y = np.arange(120) % 4
    x = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [9, 9, 1]])[y] + rng.normal(size=(120, 3)) * 0.3
    u, v = svd.distance_factors(frame(spark, x=x - x.mean(0)), 4, 5)
    got = {r.id: np.array(r.u) for r in u.collect()}
    logits = np.array([got[i] for i in range(120)]) @ v.T / math.sqrt(5)
    assert len({(int(a), int(b)) for a, b in zip(y, logits.argmax(1), strict=True)}) == 4
    assert math.isclose(np.sqrt((logits**2).mean()), 1.0, rel_tol=1e-6) and np.allclose(logits.mean(1), 0, atol=1e-8)
    with pytest.raises(ValueError, match="rank"):
        svd.distance_factors(frame(spark, x=x), 4, 1)


# attention and starts


def collected(rows, name="logits"):
    got = {r.id: r[name] for r in rows.collect()}
    return np.array([got[i] for i in range(len(got))])


def test_uv_logits_of_all_kinds(spark):
    n = frame(spark, x=X)
    centres = X[:5] + 0.1
    costs = 2 * X @ centres.T - (centres**2).sum(1)
    costs -= costs.mean(1, keepdims=True)
    s = np.linalg.svd(costs, compute_uv=False)
    u, v, lost = attention.uv_factors(n, centres, 4)
    assert lost < 1e-9 and np.allclose(collected(attention.uv_logits(u, v, 0.5)), costs / 0.5, atol=1e-9)
    u, v, lost = attention.uv_factors(n, centres, 2)
    assert math.isclose(lost, np.linalg.norm(s[2:]) / np.linalg.norm(s))
    a, b, _ = attention.uv_factors(n, centres, 2, seed=3)
    assert np.allclose(np.linalg.norm(collected(a, "u"), axis=0), np.linalg.norm(collected(u, "u"), axis=0))
    assert np.allclose(np.linalg.norm(b, axis=0), np.linalg.norm(v, axis=0)) and np.allclose(b.mean(0), 0)
    assert np.allclose(collected(a, "u"), collected(attention.uv_factors(n.repartition(1), centres, 2, seed=3)[0], "u"))
    for rank in (0, 5):
        with pytest.raises(ValueError, match="rank"):
            attention.uv_factors(n, centres, rank)
    with pytest.raises(ValueError, match="tau"):
        attention.uv_logits(u, v, 0.0)


def test_prototypes_anchors_and_encoders(spark):
    n = frame(spark, x=X, cell=np.arange(N) % 3)
    assert np.allclose(attention.prototypes(n, 3), [X[k::3].mean(0) for k in range(3)])
    with pytest.raises(ValueError, match="3"):
        attention.prototypes(n, 4)
    anchors = attention.random_anchors(n, 6, 1)
    assert np.array_equal(anchors, attention.random_anchors(n.repartition(2), 6, 1)) and len({tuple(a) for a in anchors}) == 6
    with pytest.raises(ValueError, match="fewer"):
        attention.random_anchors(n, N + 1)
    assert [w.shape for w in attention.initial_encoder(7, 3)] == [(7, 3)] and [w.shape for w in attention.initial_encoder(7, 3, 5)] == [(7, 5), (5,), (5, 3)]
