"""Seeding, cuts, students, teachers and the drivers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.minimise import minimise
from quern.functions.stages import cut
from quern.operators import assign, features, graph, heads, moments, partition, scatter, seeding, students
from quern.plans import drivers
from quern.sources import views


def frame(spark, x, **more):
    names = ", ".join(f"{k} {t}" for k, (t, _) in more.items())
    rows = [(i, r.tolist(), *(v[i] for _, v in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id long, x array<double>{', ' + names if names else ''}").repartition(6)


def blobs(n=240, d=3, k=4, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(k, d)) * 6
    y = np.arange(n) % k
    return centre[y] + rng.normal(size=(n, d)), y


# cuts


def best_cut(p, x):
    """(below, value, gain) by trying every cut between distinct values."""
    order = np.argsort(p, kind="stable")
    p, x, found = p[order], x[order], None
    scatter_of = lambda a: ((a - a.mean(0)) ** 2).sum()
    for k in range(1, len(p)):
        if p[k - 1] < p[k]:
            gain = scatter_of(x) - scatter_of(x[:k]) - scatter_of(x[k:])
            if found is None or gain > found[2] + 1e-9:
                found = (k, p[k - 1], gain)
    return found


@pytest.mark.parametrize(("case", "ranges"), list(itertools.product(("skew", "ties", "hot", "two"), (2, 7, 64))))
def test_scatter_cut_over_all_dimensions_equals_trying_all(spark, case, ranges):
    rng = np.random.default_rng(len(case))
    n = 300
    p = {"skew": rng.exponential(size=n) ** 4, "ties": rng.integers(0, 9, n).astype(float), "hot": np.where(rng.random(n) < 0.6, 1.0, rng.normal(size=n)), "two": rng.integers(0, 2, n).astype(float)}[case]
    x = rng.normal(size=(n, 4)) + np.where(p > np.quantile(p, 0.8), 3.0, 0.0)[:, None] * [0, 1, 0, -2]
    x -= x.mean(0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = scatter.scatter_cut(frame(spark, x, p=("double", p.tolist())).select("p", "x"), ranges).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    below, value, gain = best_cut(p, x)
    assert (got.below, got.value) == (below, value) and math.isclose(got.gain, gain, abs_tol=1e-6)


def test_scatter_cut_sees_what_the_projection_does_not(spark):
    """Along p all cuts are alike; the second dimension decides."""
    p = np.arange(10.0)
    x = np.stack([np.zeros(10), np.where(p < 3, 5.0, 0.0)], 1)
    got = scatter.scatter_cut(frame(spark, x - x.mean(0), p=("double", p.tolist()))).first()
    assert got.below == 3 and partition.scatter_cut(frame(spark, x, p=("double", p.tolist())).select("id", "p")).first().below == 5


def test_equal_projections_split_in_half_and_no_points(spark):
    same = frame(spark, np.ones((7, 2)), p=("double", [2.0] * 7))
    assert scatter.scatter_cut(same).first() is None
    assert sorted((r.id, r.low) for r in scatter.scatter_split(same).collect()) == [(i, i < 3) for i in range(7)]
    assert scatter.scatter_cut(same.limit(0)).first() is None
    assert [r.low for r in scatter.scatter_split(same.limit(1)).collect()] == [False]


# seeding


def cost(x, centres):
    return ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_seeding_is_as_good_as_one_centre_after_the_other(spark):
    x, _ = blobs(400, 3, 8)
    n = cut(frame(spark, x))
    seeds = [0, 1, 2]
    found = seeding.spread_centres(n, 8, seeds)
    old = np.mean([cost(x, np.array([r.c for r in partition.spread_centres(n, 8, s).collect()])) for s in seeds[:2]])
    assert [len(c) for c in found] == [8] * 3 and np.mean([cost(x, c) for c in found]) <= 1.05 * old
    again = seeding.spread_centres(n.repartition(2), 8, seeds)
    assert all(np.allclose(a, b) for a, b in zip(found, again, strict=True)) and not np.allclose(found[0], found[1])


def test_passes_of_seeding_do_not_follow_the_cells(spark):
    def jobs(cells):
        n = cut(frame(spark, blobs(200)[0]))
        spark.sparkContext.setJobGroup(f"seed{cells}", "")
        seeding.spread_centres(n, cells, [0])
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"seed{cells}"))

    assert abs(jobs(4) - jobs(64)) <= 2


def test_seeding_with_few_distinct_nodes(spark):
    x = np.repeat(np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 0.0]]), 4, axis=0)
    found = seeding.spread_centres(frame(spark, x), 3)[0]
    assert sorted(map(tuple, found)) == [(0, 0), (5, 5), (9, 0)]
    assert len(seeding.spread_centres(frame(spark, x), 6)[0]) == 6
    with pytest.raises(ValueError, match="fewer nodes"):
        seeding.spread_centres(frame(spark, x), 13)


def test_nearest_cells_of_many_centres(spark):
    x, _ = blobs(50)
    sets = [x[:3], x[5:12]]
    got = {r.id: r.cells for r in seeding.nearest_cells(frame(spark, x), sets).collect()}
    for k, c in enumerate(sets):
        assert [got[i][k] for i in range(50)] == ((x[:, None] - c) ** 2).sum(2).argmin(1).tolist()


# minimiser, heads and teachers


def test_minimise_solves_problems_in_step():
    rng = np.random.default_rng(4)
    a = [np.diag(10.0 ** rng.uniform(-2, 2, 6)) for _ in range(3)]
    b = [rng.normal(size=6) for _ in range(3)]
    calls = []

    def evaluate(points):
        calls.append(len(points))
        return {k: (0.5 * x @ a[k] @ x - b[k] @ x, a[k] @ x - b[k]) for k, x in points.items()}

    runs = minimise({k: np.zeros(6) for k in range(3)}, evaluate, 1e-7, 2000)
    assert all(r.settled and np.allclose(r.x, np.linalg.solve(a[k], b[k]), atol=1e-4) for k, r in runs.items())
    assert calls[0] == 3 and calls[-1] == 1


def test_heads_equal_spark_ml(spark):
    x, y = blobs(120)
    n = frame(spark, x, q=("array<double>", np.eye(4)[y].tolist()), cell=("int", (np.arange(120) % 12).tolist()))
    cells = moments.representatives(n)
    theta, _ = heads.fit_head(cells, 0.1)
    rows = cells.orderBy("cell").collect()
    own = (np.array([float(r.n) for r in rows]), np.array([r.c for r in rows]), np.array([r.s for r in rows]))
    found = students.fit_heads(spark, [own, None, own], 0.1)
    assert found[1] == (None, None) and np.allclose(found[0][0], theta, atol=1e-4) and np.allclose(found[0][0], found[2][0])
    measured = students.metrics(frame(spark, x, y=("int", y.tolist()), split=("string", [["train", "val", "test", "other"][i % 4] for i in range(120)])), [found[0][0], None])
    guess = (np.concatenate((x, np.ones((120, 1))), 1) @ found[0][0].T).argmax(1)
    assert measured[1] == {} and measured[0]["val_acc"] == pytest.approx(100 * (guess == y)[1::4].mean()) and measured[0]["test_acc"] == pytest.approx(100 * (guess == y)[2::4].mean())


def test_teacher_path_is_stationary_and_the_fixed_values_win(spark):
    # from the fixtures: penalty .1 wins with accuracy 100
    x = np.array([[-2.0], [-1.0], [1.0], [2.0]])
    n = frame(spark, x, y=("int", [0, 0, 1, 1]), split=("string", ["train", "val", "val", "train"]))
    thetas, table = students.teacher_path(n, [0.1, 1.0], tolerance=1e-8)
    rows = table.orderBy(F.desc("val_acc"), "val_ce", "candidate").collect()
    assert rows[0].penalty == 0.1 and rows[0].val_acc == 100 and all(r.grad_max <= 1e-8 for r in rows)
    z, target = np.array([[-2.0, 1.0], [2.0, 1.0]]), np.eye(2)
    for theta, p in zip(thetas, (0.1, 1.0), strict=True):
        prob = np.exp(students.log_softmax(z @ theta.T))
        assert np.abs((prob - target).T @ z / 2 + p * theta).max() < 1e-7
    with pytest.raises(ValueError, match="penalties"):
        students.teacher_path(n, [0.0])


def test_all_penalties_share_their_scans(spark):
    x, y = blobs(200)
    n = cut(frame(spark, x, y=("int", y.tolist()), split=("string", [["train", "val"][i % 2] for i in range(200)])))

    def jobs(penalties):
        spark.sparkContext.setJobGroup(f"path{len(penalties)}", "")
        _, table = students.teacher_path(n, penalties, per_row=True)
        steps = max(r.iterations for r in table.collect())
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"path{len(penalties)}")), steps

    alone = [jobs([p]) for p in (0.1, 10.0)]
    together, _ = jobs([0.1, 10.0, 3.0])
    assert together < sum(a for a, _ in alone) + 20


def test_kernel_teacher_path_equals_single_fits(spark, sf):
    n = views.nodes(spark, sf).where("id < 150")
    basis = n.where("split = 'train'").orderBy("id").limit(12)
    phi = cut(features.kernel_values(n, basis, "relu").join(n.select("id", "y", "split"), "id"))
    thetas, _ = students.teacher_path(phi, [0.1, 1.0], "k", bias=False, per_row=True, tolerance=1e-6)
    for theta, gamma in zip(thetas, (0.1, 1.0), strict=True):
        want = heads.kernel_teacher(phi.select("id", "k"), n, gamma)
        got = {r.id: r.logits for r in students.with_logits(phi, theta, "k").collect()}
        for r in want.collect():
            a, b = np.array(got[r.id]), np.array(r.logits)
            assert np.allclose(a - a.mean(), b - b.mean(), atol=5e-3)


# drivers


def small(spark, n=160, k=4):
    x, y = blobs(n, 3, k)
    split = ["train" if i % 10 < 6 else "val" if i % 10 < 8 else "test" for i in range(n)]
    return cut(features.class_mean_logits(frame(spark, x, y=("int", y.tolist()), split=("string", split))))


def test_push_of_all_alphas_reaches_each_fixed_point(spark):
    n = small(spark, 40)
    w = cut(graph.push_weights(views.ring_edges(n)))
    source = cut(drivers.source_labels(n, 4))
    both = graph.push_steps(w, source, [0.2, 0.8], tolerance=1e-9)
    for k, a in enumerate((0.2, 0.8)):
        single = {(r.id, r.c): r.p for r in graph.push_labels(w, source, a, 1e-9).collect()}
        mine = {(r.id, r.c): r.p for r in both.where(F.col("k") == k).collect()}
        assert single.keys() == mine.keys() and all(math.isclose(mine[i], single[i], abs_tol=1e-7) for i in mine)
    with pytest.raises(ValueError, match="alpha"):
        graph.push_steps(w, source, [1.0])
    with pytest.raises(RuntimeError, match="settle"):
        graph.push_steps(w, source, [0.9], most_steps=2)


def test_propagation_driver_picks_by_validation(spark):
    n = small(spark)
    search, summary = drivers.propagation_kmeans(n, views.ring_edges(n), 8, (0.2, 0.9), (0.5,), (0.1, 10.0), 5)
    rows = search.orderBy("candidate").collect()
    assert [r.method for r in rows] == ["push"] * 2 + ["kernel"] * 2 and all(r.error is None for r in rows)
    for r in summary.collect():
        own = [x for x in rows if x.method == r.method]
        assert r.candidate == min((-x.val_acc, x.candidate) for x in own)[1] and r.test_acc is not None
    # separated groups: the kernel's labels are right
    assert max(r.val_acc for r in rows if r.method == "kernel") > 90


def test_adaptive_temperature_driver(spark):
    n = small(spark)
    placed = cut(n.select("id", (F.col("id") % 8).cast("int").alias("cell")))
    search, summary = drivers.adaptive_temperature(n, placed, 8, 0.5, (1.0, 0.0))
    rows = search.orderBy("candidate").collect()
    assert [(r.base_t, r.eta) for r in rows] == [(0.5, 0.0), (0.5, 1.0), (1.0, 0.0), (1.0, 1.0)]
    assert rows[0].mean_t == 0.5 and rows[1].mean_t > 0.5 and rows[1].max_t <= 1.0 and rows[3].node_entropy >= rows[2].node_entropy
    phases = {(r.base_t, r.phase): r.candidate for r in summary.collect()}
    assert phases[0.5, "global"] == 0 and phases[1.0, "global"] == 2 and set(phases) == {(b, p) for b in (0.5, 1.0) for p in ("global", "selected")}


def test_ablation_driver_pairs_by_seed(spark):
    n = small(spark, 120)
    summary, parts, scored = drivers.variance_ablation(n, 6, 1.0, 1.0, (1, 2), most_sweeps=20)
    rows = {r.variant: r for r in summary.collect()}
    assert set(rows) == set(drivers.VARIANTS) and rows["main"].val_delta == 0 and all(r.pairs == 2 for r in rows.values())
    by = {(r.variant, r.seed): r for r in parts.collect()}
    assert all(r.error is None for r in by.values())
    assert by["main", 1].common_j == pytest.approx(by["main", 1].optimized_j) and by["main", 1].common_j <= by["initialization_only", 1].common_j + 1e-12
    got = {(r.variant, r.seed): r for r in scored.collect()}
    want = np.mean([got["kmeans_plus_plus", s].val_acc - got["main", s].val_acc for s in (1, 2)])
    assert rows["kmeans_plus_plus"].val_delta == pytest.approx(want)
    with pytest.raises(ValueError, match="seeds"):
        drivers.variance_ablation(n, 6, 1.0, 1.0, (1, 1))


def test_sweep_keeps_failures_apart(spark, tmp_path):
    from quern.plans.sweep import run_sweep

    n = small(spark, 100)
    scores, ranking, test = run_sweep(spark, n, str(tmp_path), [1.0, -1.0], [1.0], 4, (0, 1), sweeps=2)
    rows = {(r.temperature, r.condensation_seed): r for r in scores.collect()}
    assert all(rows[-1.0, s].status == "failed" and rows[-1.0, s].error and rows[-1.0, s].val_acc is None for s in (0, 1))
    assert all(rows[1.0, s].val_acc is not None for s in (0, 1)) and ranking.count() == 1 and 0 <= test <= 100


def test_vector_propagation_equals_dense_products(spark):
    rng = np.random.default_rng(8)
    n = 40
    a = (rng.random((n, n)) < 0.15) * rng.random((n, n))
    a[0] = rng.random(n)  # a hub
    a[7] = 0  # receives nothing
    x = rng.normal(size=(n, 3))
    src, dst = np.nonzero(a)
    weights = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(src, dst, strict=True)], "src long, dst long, w double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.id: r.x for r in graph.propagate_vectors(weights, frame(spark, x), 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 7 not in got and set(got) == set(np.flatnonzero(a.any(1)).tolist())
    b = a.copy()
    b[:, 7] = 0  # what receives nothing has nothing to send
    assert np.allclose([got[i] for i in sorted(got)], (b @ (a @ x))[sorted(got)])


@pytest.mark.parametrize("k", [1, 4, 30])
def test_pruned_neighbours_equal_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(graph, "PART", 6)
    monkeypatch.setattr(graph, "BLOCK", 50)
    x, _ = blobs(160, 3, 8, seed=k)
    x = np.round(x, 1)
    x[10:20] = x[0]  # ties
    split = ["train" if i % 3 else "val" for i in range(160)]
    found, share = graph.pruned_nearest(frame(spark, x, split=("string", split)), k, 9)
    train = [i for i in range(160) if i % 3]
    want = {(i, r): t for i in range(160) for r, (_, t) in enumerate(sorted((round(((x[i] - x[t]) ** 2).sum(), 12), t) for t in train)[:k], 1)}
    assert {(r.id, r["rank"]): r.other for r in found.collect()} == want
    # eight groups far apart: most cells are never met
    assert share < (0.5 if k < 30 else 1.01)


def test_labels_of_all_candidates_are_one_row_a_node_and_method(spark):
    """Means of cells from whole vectors equal those of single rows; a step moves a vector an edge."""
    n = small(spark, 60)
    edges = views.ring_edges(n)
    grid, labels = drivers.propagated_labels(n, edges, 4, (0.5, 0.8), (1.0,), (0.5, 10.0), 5, 3, 0.8)
    assert labels.count() == 120 and len(grid) == 4
    placed = n.select("id", (F.col("id") % 3).cast("int").alias("cell"))
    got = drivers.label_means(labels, placed, len(grid), 3, 4)
    w, near = cut(graph.push_weights(edges)), cut(graph.nearest_train(n, 5))
    source = cut(drivers.source_labels(n, 4))
    singles = []
    for a in (0.5, 0.8):
        q = source
        for _ in range(3):
            q = graph.push_step(w, source, q, a)
        singles.append(q)
    singles += [assign.kernel_labels(near, n.where("split = 'train'"), 4, 0.8, b) for b in (0.5, 10.0)]
    for mean, rows in zip(got, singles, strict=True):
        for r in rows.join(placed, "id").groupBy("cell", "c").agg(F.avg("p").alias("p")).collect():
            assert math.isclose(mean[r.cell, r.c], r.p, abs_tol=1e-12)
    alone = graph.push_vectors(w.where("src = 0"), n.where("id > 0").select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("s")), [0.5], 1)
    assert {tuple(r.p) for r in alone.collect()} == {(0.5, 0.0)}  # nodes that receive nothing


def test_kernel_values_are_computed_once_for_the_teacher(spark, sf):
    """Fit, count and outputs read stored rows: the kernels' tasks run once."""
    from quern.operators import factors

    seen = spark.sparkContext.accumulator(0)
    n = views.nodes(spark, sf).where("id < 120")

    def counted(x):
        seen.add(len(x))
        return np.tanh(x[:, :6])

    heads.kernel_teacher(factors.mapped(n, counted, name="k"), n, 0.1).collect()
    assert seen.value == 120


def test_push_moves_one_vector_of_classes_for_all_alphas(spark, monkeypatch):
    n = small(spark, 40)
    w = cut(graph.push_weights(views.ring_edges(n)))
    moved, propagate = [], graph.propagate_vectors

    def seen(weights, rows, hops=1):
        moved.append(len(rows.first().x))
        # what a step reads is stored, so no step is computed again
        assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
        return propagate(weights, rows, hops)

    monkeypatch.setattr(graph, "propagate_vectors", seen)
    graph.push_vectors(w, drivers.source_vectors(n, 4), [0.2, 0.5, 0.8], 3).collect()
    assert moved == [4, 4, 4]
