"""Identities, brute force and contracts of the operators on tiny inputs."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors as v
from quern.functions.stages import cut
from quern.operators import assign, features, graph, heads, moments, partition, selection
from quern.plans import catalog, oracles
from quern.sources import views


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(18, 4))
    q = np.exp(rng.normal(size=(18, 3)))
    q /= q.sum(1, keepdims=True)
    rows = [(i, x[i].tolist(), q[i].tolist(), i % 3, "train" if i % 3 else "val", i % 3) for i in range(18)]
    return cut(spark.createDataFrame(rows, "id long, x array<double>, q array<double>, y int, split string, cell int"))


def objective(rows, weight=1.0):
    x, q, cell = (np.array([r[k] for r in rows]) for k in ("x", "q", "cell"))
    var = (x**2).sum(1).mean()
    m = x.T @ q / len(x)
    for j in set(cell):
        own = cell == j
        c, s, n = x[own].mean(0), q[own].mean(0), own.sum()
        var -= n * c @ c / len(x)
        m -= n * np.outer(c, s) / len(x)
    return var, math.sqrt((m**2).sum()), var + weight * math.sqrt((m**2).sum())


def test_moment_objective_equals_dense(nodes):
    got = moments.moment_objective(nodes, 1.0).first()
    assert np.allclose(tuple(got), objective(nodes.collect()))


def test_move_delta_equals_reaggregation(nodes):
    rows = [r.asDict() for r in nodes.collect()]
    before = objective(rows)[2]
    got = {r.id: r.delta for r in partition.move_deltas(nodes, 1.0, (F.col("cell") + 1) % 3).collect()}
    assert len(got) == 18
    for r in rows:
        old, r["cell"] = r["cell"], (r["cell"] + 1) % 3
        assert got[r["id"]] == pytest.approx(objective(rows)[2] - before, abs=1e-10)
        r["cell"] = old


def test_moment_partition_never_rises(nodes):
    _, history, status = partition.moment_partition(nodes, 1.0, most_sweeps=5)
    assert all(b < a for a, b in itertools.pairwise(history))
    assert status in {"no_proposal", "filtered_rejected", "iteration_limit"}


def test_lloyd_settles_and_fills_every_cell(nodes):
    placed, sweeps = partition.lloyd(nodes.drop("cell"), partition.spread_centres(nodes, 4), 30)
    assert placed.select("cell").distinct().count() == 4
    again = partition.lloyd_step(placed, moments.means(placed, "x", "c"))
    same = assign.nearest_cell(placed.withColumnRenamed("cell", "old"), again)
    assert same.where("cell <> old").isEmpty()
    assert sweeps <= 30


def test_variance_split_fixed_values(spark):
    points = [(-10.0, 0.0), (-2.0, 1.0), (3.0, -1.0), (5.0, 0.0)]
    n = spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "id long, x array<double>")
    assert [r.cell for r in partition.divisive(n, 2).orderBy("id").collect()] == [0, 0, 1, 1]


def test_scatter_cut_equals_brute_force(spark):
    p = [0.0, 1.0, 1.0, 4.0, 5.0, 5.5, 9.0]
    best = max(range(1, len(p)), key=lambda k: (-np.var(p[:k]) * k - np.var(p[k:]) * (len(p) - k) if p[k - 1] < p[k] else -1e9, -k))
    got = partition.scatter_cut(spark.createDataFrame(list(enumerate(p)), "id long, p double")).first()
    assert got.below == best
    assert got.gain == pytest.approx(np.var(p) * len(p) - np.var(p[:best]) * best - np.var(p[best:]) * (len(p) - best))


def test_scatter_cut_fixes_its_ranges_and_counts_points_without_a_value(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = [None if i % 50 == 7 else [] if i % 50 == 8 else [float(p)] for i, p in enumerate(rng.normal(size=500))]
    rows = [(i, p, 0) for i, p in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert [tuple(r) for r in catalog.min_scatter_cut(spark, str(tmp_path)).collect()] == con.execute(oracles.SQL["min_scatter_cut"]).fetchall()
    # the edges of many values differ from one evaluation to the next, so no plan may find them again
    found = partition.scatter_cut(spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 4.0)], "id long, p double"))
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_divergence_is_infinite_without_support(spark):
    rows = [(0, [0.0], [1.0, 0.0], 0), (1, [0.1], [1.0, 0.0], 0), (2, [0.2], [0.0, 1.0], 1), (3, [0.3], [0.0, 1.0], 1)]
    n = spark.createDataFrame(rows, "id long, x array<double>, q array<double>, cell int")
    got = {r.id: r.costs for r in partition.divergence_proposal(n, 1.0).collect()}
    assert got[0][1] == math.inf and got[2][0] == math.inf
    assert [r.target for r in partition.divergence_proposal(n, 1.0).orderBy("id").collect()] == [0, 0, 1, 1]


def test_tied_cost_keeps_the_cell(spark):
    n = spark.createDataFrame([(0, [1.0, 1.0, 2.0], 1), (1, [1.0, 0.5, 0.5], 0)], "id long, costs array<double>, cell int")
    assert [r.t for r in n.orderBy("id").select(assign.keep_if_tied("costs", "cell").alias("t")).collect()] == [1, 1]


def test_sinkhorn_marginals(nodes):
    n = nodes.withColumn("logits", F.transform("x", lambda a: a * 0.5))
    p = np.array([r.p for r in assign.balanced(n, 4, 6).collect()])
    assert np.allclose(p.sum(1), 1)
    assert np.allclose(p.mean(0), 0.25, atol=1e-3)


def test_push_reaches_the_fixed_point(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 2)], "src long, dst long")
    source = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.0), (2, 1, 1.0)], "id long, c int, p double")
    w = graph.push_weights(edges)
    r = np.zeros((3, 3))
    for e in w.collect():
        r[e.src, e.dst] = e.w
    assert np.allclose(r.sum(1), 1)
    got = np.zeros((3, 2))
    for e in graph.push_labels(w, source, 0.8, 1e-9).collect():
        got[e.id, e.c] = e.p
    want = np.linalg.solve(np.eye(3) - 0.8 * r, 0.2 * np.array([[1, 0], [0.5, 0.5], [0, 1]]))
    assert np.allclose(got, want, atol=1e-6)
    with pytest.raises(RuntimeError):
        graph.push_labels(w, source, 0.8, 1e-12, most_steps=5)


def test_self_loop_rules(spark):
    n = spark.range(2)
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "src long, dst long")
    assert graph.symmetric_weights(edges, "auto", n).count() == 3
    assert graph.symmetric_weights(edges, "missing", n).count() == 4
    bare = edges.where("src <> dst")
    assert graph.symmetric_weights(bare, "auto", n).count() == 4
    assert graph.symmetric_weights(bare, "keep").count() == 2


def test_rms_is_unit_and_shift_free(nodes):
    z = features.rms_features(nodes)
    assert z.agg(F.avg(v.squared_norm("x"))).first()[0] == pytest.approx(1)
    moved = features.rms_features(nodes.withColumn("x", F.transform("x", lambda a: a * 3 + 7)))
    a, b = (np.array([r.x for r in d.orderBy("id").collect()]) for d in (z, moved))
    assert np.allclose(a, b)


def test_adaptive_temperature_fixed_values(spark):
    d = spark.createDataFrame([(0, "train", 1e-7), (1, "val", 0.0), (2, "val", 2.0), (3, "test", 4.0)], "id long, split string, d double")
    got = [(r.position, r.t) for r in features.adaptive_temperature(d, 1.0, 1.0).orderBy("id").collect()]
    assert got == [(0.0, 1.0), (0.0, 1.0), (0.5, 1.5), (pytest.approx(2 / 3), pytest.approx(5 / 3))]


def test_whitening_evens_the_spectrum(nodes):
    z = np.array([r.x for r in features.whitened(nodes, power=1.0, ridge=0.0).collect()])
    e = np.linalg.eigvalsh(np.cov(z.T))
    assert e.max() / e.min() == pytest.approx(1, rel=1e-6)


def test_head_is_stationary_with_penalised_bias(nodes):
    theta, _ = heads.fit_head(moments.representatives(nodes), 0.1)
    theta = np.array(theta)
    cells = moments.representatives(nodes).collect()
    mass = np.array([r.n for r in cells]) / 18
    z = np.array([[*r.c, 1.0] for r in cells])
    p = np.exp(z @ theta.T)
    p /= p.sum(1, keepdims=True)
    grad = (p - np.array([r.s for r in cells])).T @ (z * mass[:, None]) + 0.1 * theta
    assert np.abs(grad).max() < 1e-5


def test_temperature_curve_finds_the_scale(spark):
    rows = [([8.0, 0.0], 0, "val")] * 2 + [([0.0, 8.0], 0, "val"), ([0.0, 8.0], 1, "val")]
    n = spark.createDataFrame(rows, "logits array<double>, y int, split string")
    best = heads.temperature_curve(n, points=600).orderBy("ce").first()
    assert best.t == pytest.approx(8 / math.log(3), rel=0.02)


def scores(spark, drop=None, extra=None):
    rows = [(c, 0, a, b, 70.0 + c + a + b) for c in range(2) for a in range(3) for b in range(3) if (c, a, b) != drop]
    rows += extra or []
    return spark.createDataFrame(rows, "candidate int, step int, condensation_seed int, student_seed int, val_acc double")


def test_joint_score_and_pair_check(spark):
    got = {r.candidate: r for r in selection.joint_score(scores(spark)).collect()}
    assert got[0].val == 72 and got[1].val == 73 and got[1].val_std == 1 and got[1].evaluations == 9
    seeds = range(3), range(3)
    assert selection.missing_pairs(scores(spark), *seeds).isEmpty()
    assert selection.missing_pairs(scores(spark, drop=(1, 2, 2)), *seeds).count() == 1
    assert selection.missing_pairs(scores(spark), range(4), range(3)).count() == 2  # a seed that is missing everywhere
    assert selection.missing_pairs(scores(spark, extra=[(0, 0, 1, 1, 5.0)]), *seeds).count() == 1


def test_selection_prefers_the_earlier_step(spark):
    s = spark.createDataFrame([(1, 100, 73.0), (1, 0, 73.0), (0, 0, 72.0)], "candidate int, step int, val double")
    assert tuple(selection.best(s, [F.desc("val"), "step", "candidate"]).first()) == (1, 0, 73.0)


def test_mean_of_means_is_not_the_grand_mean(spark):
    s = spark.createDataFrame([(0, 0, 0, 0, 10.0), (0, 0, 0, 1, 20.0), (0, 0, 1, 0, 30.0)], scores(spark).schema)
    assert selection.joint_score(s).first().val == 22.5


def test_grid_order_and_fingerprint(spark):
    g = selection.grid(spark, {"a": [1.0, 2.0], "m": ["x", "y", "z"]}).orderBy("candidate").collect()
    assert [(r.a, r.m) for r in g] == [(1.0, "x"), (1.0, "y"), (1.0, "z"), (2.0, "x"), (2.0, "y"), (2.0, "z")]
    f = selection.fingerprint(spark.createDataFrame(g), ["m", "a"]).select("fingerprint")
    assert f.distinct().count() == 6


def test_dense_ids_and_roles(spark):
    ids = spark.createDataFrame([(i,) for i in (5, 9000, 17, 4097)], "id long")
    assert {r.id: r.dense for r in views.dense_ids(ids).collect()} == {5: 0, 17: 1, 4097: 2, 9000: 3}
    roles = spark.createDataFrame([(5, "tr"), (17, "va")], "id long, role string")
    assert {r.id: r.split for r in views.split_of_roles(ids, roles).collect()} == {5: "train", 17: "val", 4097: None, 9000: None}


def test_streamed_moments_equal_batch(spark, nodes, tmp_path):
    from quern.streaming.moments import current_moments, running_moments

    nodes.select("cell", "x").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell int, x array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running_moments(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {(r.cell, r.dim): (r.n, r.s / r.n) for r in current_moments(spark, str(tmp_path / "out")).collect()}
    for r in moments.means(nodes, "x", "c").collect():
        for k, m in enumerate(r.c):
            assert got[r.cell, k] == (6, pytest.approx(m))


def test_moment_gradient_equals_finite_differences():
    from quern.operators.soft import objective_and_gradient

    rng = np.random.default_rng(5)
    s, cross = rng.random((3, 1 + 4 + 2)) + 0.5, rng.normal(size=(4, 2))
    _, g = objective_and_gradient(s, 9.0, cross, 0.7)
    for i, j in np.ndindex(*s.shape):
        up, down = s.copy(), s.copy()
        up[i, j] += 1e-6
        down[i, j] -= 1e-6
        want = (objective_and_gradient(up, 9.0, cross, 0.7)[0] - objective_and_gradient(down, 9.0, cross, 0.7)[0]) / 2e-6
        assert g[i, j] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_descent_lowers_the_objective(nodes):
    from quern.operators.soft import descend

    start = nodes.withColumn("logits", assign.smoothed_logits("cell", 3, 0.3)).select("id", "x", "q", "logits")
    _, history = descend(start, 1.0, steps=3)
    assert len(history) > 1 and history[-1] < history[0]
    assert all(b <= a for a, b in itertools.pairwise(history))


def test_sweep_resumes_and_ranks_by_validation(spark, sf, tmp_path):
    from quern.plans.sweep import run_sweep

    n = cut(features.class_mean_logits(views.nodes(spark, sf).where("id < 200")))
    options = {"temperatures": [0.5, 1.0], "weights": [1.0], "cells": 4, "seeds": (0, 1), "sweeps": 1}
    scores, ranking, test = run_sweep(spark, n, str(tmp_path), **options)
    assert scores.count() == 4 and ranking.count() == 2 and 0 <= test <= 100
    before = sorted(p.name for p in (tmp_path / "scores").rglob("part-*"))
    run_sweep(spark, n, str(tmp_path), **options)
    assert before == sorted(p.name for p in (tmp_path / "scores").rglob("part-*"))
    run_sweep(spark, n.withColumn("y", (F.col("y") + 1) % 10), str(tmp_path), **options)  # other nodes reuse nothing
    assert len(list((tmp_path / "scores").iterdir())) == 8


def test_neighbours_over_parts_equal_brute_force(nodes, monkeypatch):
    from quern.operators import graph

    monkeypatch.setattr(graph, "PART", 4)
    monkeypatch.setattr(graph, "BLOCK", 5)
    rows = nodes.collect()
    for k in (1, 3, 50):
        want = {}
        for r in rows:
            d = sorted((round(sum((a - b) ** 2 for a, b in zip(r.x, t.x, strict=True)), 12), t.id) for t in rows if t.split == "train")
            want |= {(r.id, place + 1): i for place, (_, i) in enumerate(d[:k])}
        assert {(r.id, r["rank"]): r.other for r in graph.nearest_train(nodes, k).collect()} == want


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """300 copies of 8 vectors: a group gets at most k training nodes of a vector and each vector once."""
    from quern.operators import graph

    seen = spark.sparkContext.accumulator(0)
    within = graph._within

    def counted(k):
        run = within(k)

        def nearest(key, left, right):
            seen.add(left.num_rows * right.num_rows)
            return run(key, left, right)

        return nearest

    monkeypatch.setattr(graph, "_within", counted)
    x = [[float(i % 8), float(i % 8 // 2)] for i in range(2400)]
    n = spark.createDataFrame([(i, x[i], "train" if i % 3 else "val") for i in range(2400)], "id long, x array<double>, split string")
    got = {(r.id, r["rank"]): r.other for r in graph.nearest_train(n, 3).collect()}
    for i in (0, 9, 2399):
        want = sorted((round(sum((a - b) ** 2 for a, b in zip(x[i], x[t], strict=True)), 12), t) for t in range(2400) if t % 3)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [t for _, t in want]
    assert len(got) == 7200 and 0 < seen.value <= 8 * 24


def test_principal_split_equals_power_iteration(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(20, 3)) + c for c in ([0, 0, 0], [9, 1, 0], [0, 30, 2])])
    n = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    for least in (False, True):
        cell = np.array([r.cell for r in partition.principal_split(n, 3, least).orderBy("id").collect()])
        assert [len(set(cell[k : k + 20])) for k in (0, 20, 40)] == [1, 1, 1] and len(set(cell)) == 3
    # equal points have no direction: halves by id
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(8)], "id long, x array<double>")
    assert [r.cell for r in partition.principal_split(same, 2).orderBy("id").collect()] == [0] * 4 + [1] * 4


def test_partition_loops_fill_cells_and_never_rise(spark, nodes):
    few = nodes.withColumn("cell", F.when(F.col("id") < 9, 0).otherwise(2).cast("int"))
    for placed, history, status in (partition.variance_partition_loop(few, 3, "x", 10), partition.divergence_partition(few, 3, 1.0, 10)):
        assert status in {"assignment_stable", "iteration_limit"} and all(b <= a + 1e-9 for a, b in itertools.pairwise(history))
        assert placed.select("cell").distinct().count() == 3 or status == "assignment_stable"


def test_calibration_finds_the_closed_forms(spark):
    n = spark.createDataFrame([([8.0, 0.0], 0, "val"), ([8.0, 0.0], 0, "val"), ([0.0, 8.0], 1, "val"), ([0.0, 8.0], 0, "val")], "logits array<double>, y int, split string")
    found, where = heads.calibrated_temperature(n)
    assert found.first().t == pytest.approx(8 / math.log(3), rel=1e-6) and where == "interior"
    ten = spark.createDataFrame([([10.0, 0.0], 0, "val")] * 8 + [([0.0, 10.0], 0, "val")] * 2, n.schema)
    found, where = heads.calibrated_temperature(ten, 0.01, 100.0, log_scale=True)
    assert found.first().t == pytest.approx(10 / math.log(4), rel=1e-6) and where == "interior"
    edge = spark.createDataFrame([([1.0, 0.0], 0, "val"), ([0.0, 1.0], 1, "val")], n.schema)
    found, where = heads.calibrated_temperature(edge)
    assert found.first().t == pytest.approx(0.05) and where == "lower"


def test_projection_and_factors_span_the_leading_axes(spark, nodes):
    from quern.operators import factors

    x = np.array([r.x for r in nodes.orderBy("id").collect()])
    h = np.array([r.h for r in factors.projected(nodes, 2).orderBy("id").collect()])
    s = np.linalg.svd(x)[1]
    assert np.allclose(np.sort((h**2).sum(0))[::-1], s[:2] ** 2)
    cells = np.random.default_rng(1).normal(size=(5, 4))
    u, right = factors.balanced_factors(nodes, cells, 4)
    u = np.array([r.u for r in u.orderBy("id").collect()])
    assert np.allclose(u @ right.T / 2, x @ cells.T)


def test_checks_raise_and_report(spark):
    from quern.operators import checks

    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    twice = a.union(a.where("k = 1"))
    assert checks.checked_join(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    assert checks.checked_join(twice, a.withColumnRenamed("v", "w"), ["k"], "many_to_one").count() == 3
    for left, right, kind in ((twice, a, "one_to_one"), (a, twice, "many_to_one")):
        with pytest.raises(ValueError):
            checks.checked_join(left, right.withColumnRenamed("v", "w"), ["k"], kind)
    with pytest.raises(ValueError):
        checks.members(spark.createDataFrame([(9,)], "k int"), a, ["k"])
    with pytest.raises(Exception, match="not finite"):
        checks.require_finite(spark.createDataFrame([(1, float("nan"))], a.schema), ["v"]).collect()


def test_lloyd_stores_the_nodes_once_and_fills_empty_cells(spark, monkeypatch):
    from quern.operators import assign, partition

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)) + c for c in ([0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6])])
    n = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    written = []
    for name in ("cut", "stored"):
        run = getattr(partition, name)
        monkeypatch.setattr(partition, name, lambda df, *a, run=run: (written.append(1), run(df, *a))[1])
    # the last two centres are nobody's nearest
    start = spark.createDataFrame(list(enumerate([*x[[0, 1, 2, 61]].tolist(), [99.0] * 3, [98.0] * 3])), "cell int, c array<double>")
    placed, sweeps = partition.lloyd(n, start, 40)
    assert len(written) == 1 and 1 < sweeps < 40
    rows = placed.orderBy("id").collect()
    cell = np.array([r.cell for r in rows])
    assert set(cell.tolist()) == set(range(6))
    means = np.stack([x[cell == j].mean(0) for j in range(6)])
    assert (((x[:, None] - means) ** 2).sum(2).argmin(1) == cell).all()
    same = assign.nearest_cell(n, spark.createDataFrame(list(enumerate(means.tolist())), "cell int, c array<double>"))
    assert [r.cell for r in same.orderBy("id").collect()] == cell.tolist()
