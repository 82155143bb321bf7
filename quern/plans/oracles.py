"""The same queries as SQL for an independent engine over the same tables."""

from __future__ import annotations

from ..sources.views import CELLS, CLASSES

#: Named relations; each query takes those it needs, in this order.
PARTS = {
    "nodes": "SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label AS y, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM embeddings",
    "xl": "SELECT id, y, split, unnest(range(1, len(x) + 1)) - 1 AS dim, unnest(x) AS v FROM nodes",
    "size": "SELECT count(*) AS n FROM nodes",
    "oneway": "SELECT id AS src, (7 * id + 3) % n AS dst FROM nodes, size UNION ALL SELECT id, (11 * id + 5) % n FROM nodes, size",
    "edges": "SELECT src, dst FROM oneway UNION SELECT dst, src FROM oneway UNION SELECT id, id FROM nodes",
    "deg": "SELECT src, count(*)::DOUBLE AS d FROM edges GROUP BY src",
    "w": "SELECT e.src, e.dst, 1 / sqrt(a.d) * (1 / sqrt(b.d)) AS w FROM edges e JOIN deg a ON e.src = a.src JOIN deg b ON e.dst = b.src",
    "h1": "SELECT w.src AS id, dim, sum(w * v) AS v FROM w JOIN xl ON w.dst = xl.id GROUP BY ALL",
    "h2": "SELECT w.src AS id, dim, sum(w * v) AS v FROM w JOIN h1 ON w.dst = h1.id GROUP BY ALL",
    "cm": "SELECT y, list(m ORDER BY dim) AS c FROM (SELECT y, dim, avg(v) AS m FROM xl WHERE split = 'train' GROUP BY ALL) GROUP BY y",
    "lg": "SELECT id, nodes.y, split, x, list(-(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) ORDER BY cm.y) AS logits FROM nodes, cm GROUP BY ALL",
    "base": f"SELECT *, (id % {CELLS})::INT AS cell, list_transform(logits, lambda l: exp(l - list_max(logits)) / list_sum(list_transform(logits, lambda k: exp(k - list_max(logits))))) AS q FROM lg",
    "ql": "SELECT id, cell, unnest(range(1, len(q) + 1)) - 1 AS c, unnest(q) AS p FROM base",
    "bl": "SELECT id, cell, unnest(range(1, len(x) + 1)) - 1 AS dim, unnest(x) AS v FROM base",
    "anchors": f"SELECT id::INT AS cell, x AS c FROM nodes WHERE id < {CELLS}",
    "cost": "SELECT n.id, n.x, a.cell, list_inner_product(c, c) - 2 * list_inner_product(x, c) AS cost FROM nodes n, anchors a",
    "near": "SELECT id, arg_min(cell, (cost, cell)) AS cell FROM cost GROUP BY id",
    "cx": "SELECT cell, dim, avg(v) AS m, count(*) AS n FROM bl GROUP BY ALL",
    "cq": "SELECT cell, c, avg(p) AS m, count(*) AS n FROM ql GROUP BY ALL",
    "cells": "SELECT * FROM (SELECT cell, any_value(n) AS n, list(m ORDER BY dim) AS c FROM cx GROUP BY cell) JOIN (SELECT cell, list(m ORDER BY c) AS s FROM cq GROUP BY cell) USING (cell)",
    "mm": "SELECT a.dim AS i, a.c, a.m - b.m AS m FROM (SELECT dim, c, avg(v * p) AS m FROM bl JOIN ql USING (id) GROUP BY ALL) a JOIN (SELECT dim, c, sum(cx.n * cx.m * cq.m) / (SELECT n FROM size) AS m FROM cx JOIN cq USING (cell) GROUP BY ALL) b ON a.dim = b.dim AND a.c = b.c",
    "mnorm": "SELECT sqrt(sum(m * m)) AS norm FROM mm",
    "knn": "SELECT n.id, t.id AS other, round(list_inner_product(n.x, n.x) - 2 * list_inner_product(n.x, t.x) + list_inner_product(t.x, t.x), 9) AS d2, row_number() OVER (PARTITION BY n.id ORDER BY round(list_inner_product(n.x, n.x) - 2 * list_inner_product(n.x, t.x) + list_inner_product(t.x, t.x), 9), t.id) AS rank FROM nodes n, nodes t WHERE t.split = 'train' QUALIFY rank <= 5",
    "scores": "SELECT event_type AS candidate, user_id % 3 AS condensation_seed, event_id % 3 AS student_seed, (event_id // 3) % 2 * 100 AS step, avg(value) AS val_acc, max(value) AS test_acc FROM events GROUP BY ALL",
    "inner_": "SELECT candidate, step, condensation_seed, avg(val_acc) AS mean, stddev_samp(val_acc) AS spread, count(*) AS n FROM scores GROUP BY ALL",
    "joint": "SELECT candidate, step, round(avg(mean), 6) + 0.0 AS val, round(stddev_samp(mean), 6) + 0.0 AS val_std, round(avg(spread), 6) + 0.0 AS student_std, sum(n)::BIGINT AS evaluations FROM inner_ GROUP BY ALL",
}


def sql(select: str, parts: str = "", **more: str) -> str:
    names = parts.split()
    bodies = [f"{p} AS MATERIALIZED ({PARTS[p]})" for p in PARTS if p in names] + [f"{k} AS ({b})" for k, b in more.items()]
    return f"WITH {', '.join(bodies)} {select}" if bodies else select


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


_BASE = "nodes xl cm lg base"
_STATS = f"size {_BASE} ql bl cx cq cells mm mnorm"
_AVG_X = "SELECT dim, avg(v) AS m FROM xl GROUP BY dim"
_KERNELS = {
    "rbf": "exp(-(xx - 2 * xa + aa) / bw)",
    "linear": "xa",
    "erf": "2 / pi() * asin(greatest(-1.0 + 1e-12, least(1.0 - 1e-12, 2 * xa / bw / sqrt((1 + 2 * xx / bw) * (1 + 2 * aa / bw)))))",
    "relu": "sqrt(xx / bw * (aa / bw)) * (sin(t1) + (pi() - t1) * cos(t1)) / pi()",
    "relu2": "sqrt(xx / bw * (aa / bw)) * (sin(t2) + (pi() - t2) * cos(t2)) / pi()",
}


def _clamp(x: str) -> str:
    return f"greatest((-1.0 + 1e-12)::DOUBLE, least((1.0 - 1e-12)::DOUBLE, {x}))"


def _kernel(kind: str) -> str:
    t1 = f"acos({_clamp(_clamp('xa / bw / sqrt(xx / bw * (aa / bw))'))})"
    t2 = f"acos({_clamp('(sin(t1) + (pi() - t1) * cos(t1)) / pi()')})"
    return sql(
        f"SELECT id, a AS dim, {r(_KERNELS[kind])} AS v FROM (SELECT *, {t2} AS t2 FROM (SELECT *, {t1} AS t1 FROM k))",
        "nodes",
        k=f"SELECT n.id, a.id AS a, list_inner_product(n.x, n.x) AS xx, list_inner_product(a.x, a.x) AS aa, list_inner_product(n.x, a.x) AS xa, (SELECT avg(list_inner_product(x, x)) FROM nodes WHERE id < {CELLS}) AS bw FROM nodes n, nodes a WHERE a.id < {CELLS}",
    )


def _push() -> str:
    steps = {
        "pw0": "SELECT e.src, e.dst, 1.0::DOUBLE / n AS w FROM edges e JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) USING (dst)",
        "pw": "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM pw0",
        "s0": f"SELECT id, c, CASE WHEN split = 'train' THEN (y = c)::INT::DOUBLE ELSE 1.0::DOUBLE / {CLASSES} END AS p FROM nodes, range({CLASSES}) t(c)",
    }
    for k in (1, 2, 3):
        steps[f"s{k}"] = f"SELECT s0.id, s0.c, (1 - 0.8::DOUBLE) * s0.p + 0.8::DOUBLE * coalesce(m, 0) AS p FROM s0 LEFT JOIN (SELECT src AS id, c, sum(w * p) AS m FROM pw JOIN s{k - 1} ON pw.dst = s{k - 1}.id GROUP BY ALL) USING (id, c)"
    return sql(f"SELECT id, c, {r('p')} AS p FROM s3", "nodes size oneway edges", **steps)


def _soft(p: str, a: str, more: dict[str, str]) -> str:
    return sql(
        f"SELECT cell, dim, {r('sum(w * v) / (SELECT n FROM size)', 9)} AS s FROM ({p}) JOIN ({a}) USING (id) GROUP BY ALL",
        f"size {_BASE} anchors",
        **more,
    )


_MATERIAL = "SELECT id, unnest(range(1, len(a) + 1)) - 1 AS dim, unnest(a) AS v FROM (SELECT id, {} AS a FROM base)"
_ONE_Q = _MATERIAL.format("list_concat([1.0::DOUBLE], q)")
_ALL = _MATERIAL.format("list_concat([1.0::DOUBLE], x, q)")
_PROTO = "SELECT id, cell, exp((l - max(l) OVER (PARTITION BY id))) / sum(exp(l - top)) OVER (PARTITION BY id) AS w FROM (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM (SELECT id, cell, -cost / 0.3::DOUBLE AS l FROM cost))"
_SPARSE = "SELECT id, j AS cell, CASE WHEN own THEN 0.95 + 0.05 / 3 ELSE 0.05 / 3 END::DOUBLE AS w FROM (SELECT b.id, k.cell AS j, k.cell = b.cell AS own, row_number() OVER (PARTITION BY b.id ORDER BY (k.cell <> b.cell), round(cost, 12), k.cell) AS place FROM base b JOIN cost k USING (id)) WHERE place <= 3"


def _divisive(cells: int) -> str:
    steps = {"a1": "SELECT id, x, 0 AS cell FROM nodes"}
    for k in range(1, cells):
        steps[f"p{k}"] = f"SELECT cell, dim, avg(v) AS mean, var_pop(v) AS var, count(*) AS n FROM (SELECT cell, unnest(range(1, len(x) + 1)) AS dim, unnest(x) AS v FROM a{k}) GROUP BY ALL"
        steps[f"c{k}"] = f"SELECT cell AS at_, dim, mean FROM p{k} WHERE cell = (SELECT cell FROM p{k} GROUP BY cell ORDER BY round(sum(var * n), 9) DESC, cell LIMIT 1) ORDER BY round(var, 12) DESC, dim LIMIT 1"
        steps[f"a{k + 1}"] = f"SELECT id, x, CASE WHEN cell = at_ AND x[dim] > mean THEN {k} ELSE cell END AS cell FROM a{k}, c{k}"
    return sql(f"SELECT id, cell FROM a{cells}", "nodes", **steps)


def _sinkhorn(k: int) -> str:
    steps = {"d0": "SELECT cell, 0::DOUBLE AS d FROM anchors"}
    for s in range(k + 1):
        steps[f"l{s}"] = f"SELECT id, cell, -cost / 0.3::DOUBLE - d AS l FROM cost JOIN d{s} USING (cell)"
        steps[f"p{s}"] = f"SELECT id, cell, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY id) AS p FROM (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM l{s})"
        if s < k:
            steps[f"e{s}"] = f"SELECT cell, d + ln(m * {CELLS}) AS d FROM (SELECT cell, avg(p) AS m FROM p{s} GROUP BY cell) JOIN d{s} USING (cell)"
            steps[f"d{s + 1}"] = f"SELECT cell, d - (SELECT sum(d) / {CELLS} FROM e{s}) AS d FROM e{s}"
    return sql(f"SELECT id, cell::BIGINT AS dim, {r('p')} AS v FROM p{k}", "nodes anchors cost", **steps)


_TARGET_COST = "list_inner_product(k.c, k.c) - 2 * list_inner_product(b.x, k.c)"
SQL: dict[str, str] = {
    "s2x_propagation": sql(f"SELECT id, dim, {r('v')} AS v FROM h2", "nodes xl size oneway edges deg w h1 h2"),
    "sym_norm_degree": sql(f"SELECT src, dst, {r('w', 9)} AS w FROM w", "nodes size oneway edges deg w"),
    "gcn_norm": sql(
        f"SELECT src, dst, {r('1 / sqrt(a.d) * (1 / sqrt(b.d))', 9)} AS w FROM e JOIN dd a USING (src) JOIN (SELECT src AS dst, d FROM dd) b USING (dst)",
        "nodes size oneway edges",
        e="SELECT * FROM edges WHERE src <> dst OR src % 2 = 0 UNION SELECT id, id FROM nodes",
        dd="SELECT src, count(*)::DOUBLE AS d FROM e GROUP BY src",
    ),
    "symmetrise_edges": sql("SELECT src, dst FROM o UNION SELECT dst, src FROM o", "nodes size", o="SELECT id AS src, (7 * id + 3) % n AS dst FROM nodes, size"),
    "induced_subgraph": sql(
        "SELECT a.k AS src, b.k AS dst FROM edges JOIN v a ON src = a.id JOIN v b ON dst = b.id",
        "nodes size oneway edges",
        v="SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes WHERE split = 'val'",
    ),
    "split_roles": sql("SELECT id, CASE WHEN split <> 'test' THEN split END AS split FROM nodes", "nodes"),
    "dense_labels": sql("SELECT id, y + 4 - (SELECT min(y) + 4 FROM nodes) AS y FROM nodes", "nodes"),
    "push_operator": sql(f"SELECT src, dst, {r('w / sum(w) OVER (PARTITION BY src)', 9)} AS w FROM p", "nodes size oneway edges", p="SELECT e.src, e.dst, 1.0::DOUBLE / n AS w FROM edges e JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) USING (dst)"),
    "push_labels_k3": _push(),
    "knn_train": sql(f"SELECT id, other, rank, {r('d2')} AS d2 FROM knn", "nodes knn"),
    "kernel_labels": sql(
        f"SELECT id, c, {r(f'(coalesce(w, 0) + 0.5::DOUBLE / {CLASSES}) / (t + 0.5::DOUBLE)')} AS p FROM (SELECT id, t, c FROM (SELECT id, sum(w) AS t FROM k GROUP BY id), range({CLASSES}) g(c)) LEFT JOIN k USING (id, c)",
        "nodes knn",
        k="SELECT knn.id, o.y AS c, sum(exp(-d2 / (2 * 0.8::DOUBLE * 0.8::DOUBLE))) AS w FROM knn JOIN nodes o ON other = o.id GROUP BY ALL",
    ),
    "train_zscore": sql(f"SELECT id, dim, {r('(v - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS v FROM xl JOIN (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM xl WHERE split = 'train' GROUP BY dim) USING (dim)", "nodes xl"),
    "rms_features": sql(f"SELECT id, dim, {r('(v - m) / sqrt((SELECT sum((v - m) * (v - m)) FROM xl JOIN a USING (dim)) / (SELECT count(*) FROM nodes))')} AS v FROM xl JOIN a USING (dim)", "nodes xl", a=_AVG_X),
    "rms_features_train": sql(
        f"SELECT id, dim, {r('(v - m) / z')} AS v FROM xl JOIN a USING (dim), (SELECT sqrt(sum((v - m) * (v - m)) / count(DISTINCT id)) AS z FROM xl JOIN a USING (dim) WHERE split = 'train')",
        "nodes xl",
        a="SELECT dim, avg(v) AS m FROM xl WHERE split = 'train' GROUP BY dim",
    ),
    "l2_features": sql(f"SELECT id, dim, {r('(v - m) / sqrt(sum((v - m) * (v - m)) OVER (PARTITION BY id))')} AS v FROM xl JOIN a USING (dim)", "nodes xl", a=_AVG_X),
    "joint_embedding": sql(
        f"SELECT id, dim, {r('v / sqrt(g)')} AS v FROM (SELECT id, dim, v, g FROM zx, (SELECT sum(v * v) / (SELECT count(*) FROM nodes) AS g FROM zx) UNION ALL SELECT id, c + 64, v, g / 0.5 FROM zq, (SELECT sum(v * v) / (SELECT count(*) FROM nodes) AS g FROM zq))",
        f"{_BASE} ql bl",
        zx="SELECT id, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM bl",
        zq="SELECT id, c, p - avg(p) OVER (PARTITION BY c) AS v FROM ql",
    ),
    "bound_embedding": sql(
        f"SELECT id, dim, {r('v')} AS v FROM (SELECT id, dim, v * sqrt(1 + 0.5 * eta / 2) AS v FROM zx, g UNION ALL SELECT id, c + 64, v * sqrt(0.5 / (2 * eta)) FROM zq, g)",
        f"{_BASE} ql bl",
        zx="SELECT id, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM bl",
        zq="SELECT id, c, p - avg(p) OVER (PARTITION BY c) AS v FROM ql",
        g="SELECT sqrt((SELECT sum(v * v) FROM zq) / (SELECT sum(v * v) FROM zx)) AS eta",
    ),
    **{f"{k}_kernel_anchors": _kernel(k) for k in _KERNELS},
    "soft_labels_t": sql(
        f"SELECT id, dim, {r('exp((l - top) / 0.7::DOUBLE) / sum(exp((l - top) / 0.7::DOUBLE)) OVER (PARTITION BY id)')} AS v FROM (SELECT id, unnest(range(1, len(logits) + 1)) - 1 AS dim, unnest(logits) AS l, list_max(logits) AS top FROM lg)",
        "nodes xl cm lg",
    ),
    "adaptive_temperature": sql(
        f"SELECT id, {r('pos')} AS position, {r('0.8::DOUBLE * (1 + 1.5 * pos)')} AS t FROM (SELECT id, CASE WHEN split = 'train' THEN 0 ELSE d2 / (d2 + (SELECT quantile_disc(d2, 0.5) FROM f WHERE split <> 'train' AND d2 > 0)) END::DOUBLE AS pos FROM f)",
        "nodes knn",
        f="SELECT id, split, d2 FROM knn JOIN nodes USING (id) WHERE rank = 5",
    ),
    "nearest_cell": sql("SELECT id, cell FROM near", "nodes anchors cost near"),
    "lloyd_step": sql(
        f"SELECT cell, dim, {r('coalesce(f, c)')} AS v FROM (SELECT cell, unnest(range(1, len(c) + 1)) - 1 AS dim, unnest(c) AS c FROM anchors) LEFT JOIN (SELECT cell, dim, avg(v) AS f FROM near JOIN xl USING (id) GROUP BY ALL) USING (cell, dim)",
        "nodes xl anchors cost near",
    ),
    "sparse_candidates": sql(f"SELECT id, cell, {r('w')} AS p FROM ({_SPARSE})", f"{_BASE} anchors cost"),
    "distance_gap_scale": sql(
        f"SELECT id, cell::BIGINT AS dim, {r('(low - cost) / scale')} AS v FROM (SELECT id, cell, cost, min(cost) OVER (PARTITION BY id) AS low FROM cost), (SELECT quantile_disc(gap, 0.5) AS scale FROM (SELECT list_sort(list(cost))[2] - list_sort(list(cost))[1] AS gap FROM cost GROUP BY id) WHERE gap > 0)",
        "nodes anchors cost",
    ),
    "distance_base_raw": sql(f"SELECT id, cell::BIGINT AS dim, {r('-(cost - min(cost) OVER (PARTITION BY id)) / 0.5::DOUBLE')} AS v FROM cost", "nodes anchors cost"),
    "distance_base_normalised": sql(f"SELECT id, cell::BIGINT AS dim, {r('-d / (SELECT sqrt(avg(d * d)) FROM z) / 0.5::DOUBLE')} AS v FROM z", "nodes anchors cost", z="SELECT id, cell, cost - avg(cost) OVER (PARTITION BY id) AS d FROM cost"),
    "cell_means": sql(f"SELECT cell, dim, {r('m')} AS v FROM cx", f"{_BASE} bl cx"),
    "cell_statistics": sql(f"SELECT cell, n, {r('list_inner_product(c, c)')} AS c2, {r('list_inner_product(s, s)')} AS s2 FROM cells", f"{_BASE} ql bl cx cq cells"),
    "empty_cell_counts": sql(f"SELECT k::INT AS cell, count(id) AS n FROM range({2 * CELLS}) g(k) LEFT JOIN nodes ON (id % {CELLS}) * 2 = k GROUP BY k", "nodes"),
    "cross_moment": sql(f"SELECT dim AS i, c, {r('avg(v * p)', 9)} AS m FROM bl JOIN ql USING (id) GROUP BY ALL", f"{_BASE} ql bl"),
    "kl_objective": sql(
        f"SELECT {r('v')} AS v, {r('kl', 9)} AS kl, {r('v + 2 * kl')} AS j FROM (SELECT (SELECT avg(list_inner_product(x, x)) FROM base) - (SELECT sum(n * list_inner_product(c, c)) FROM cells) / (SELECT n FROM size) AS v, (SELECT sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p) - p * ln(m) END) / (SELECT n FROM size) FROM ql JOIN cq USING (cell, c)) AS kl)",
        f"size {_BASE} ql bl cx cq cells",
    ),
    "normalized_variance_objective": sql(
        f"SELECT {r('(SELECT sum((v - m) * (v - m)) FROM bl JOIN cx USING (cell, dim)) / (SELECT sum((v - a) * (v - a)) FROM bl JOIN (SELECT dim, avg(v) AS a FROM bl GROUP BY dim) USING (dim)) + 0.5 * (SELECT sum((p - m) * (p - m)) FROM ql JOIN cq USING (cell, c)) / (SELECT sum((p - a) * (p - a)) FROM ql JOIN (SELECT c, avg(p) AS a FROM ql GROUP BY c) USING (c))')} AS j",
        f"size {_BASE} ql bl cx cq",
    ),
    "moment_cost_proposal": sql(
        "SELECT id, CASE WHEN own <= low THEN cell ELSE first_ END AS target FROM (SELECT id, any_value(cell) AS cell, min(cost) AS low, min(CASE WHEN j = cell THEN cost END) AS own, arg_min(j, (cost, j)) AS first_ FROM k GROUP BY id)",
        _STATS,
        gs="SELECT cell, list(v ORDER BY i) AS gs FROM (SELECT cells.cell, i, sum(mm.m / norm * cq.m) AS v FROM (SELECT i, c, mm.m, norm FROM mm, mnorm) AS mm JOIN cq USING (c) JOIN cells ON cells.cell = cq.cell GROUP BY ALL) GROUP BY cell",
        gc="SELECT cell, list(v ORDER BY c) AS gc FROM (SELECT cx.cell, mm.c, sum(mm.m / norm * cx.m) AS v FROM mm, mnorm, cx WHERE cx.dim = mm.i GROUP BY ALL) GROUP BY cell",
        k=f"SELECT b.id, b.cell, k.cell AS j, {_TARGET_COST} - list_inner_product(b.x, gs) - list_inner_product(b.q, gc) + list_inner_product(k.c, gs) AS cost FROM base b, cells k JOIN gs USING (cell) JOIN gc USING (cell)",
    ),
    "divergence_proposal": sql(
        "SELECT id, CASE WHEN own <= low THEN cell ELSE first_ END AS target FROM (SELECT id, any_value(cell) AS cell, min(cost) AS low, min(CASE WHEN j = cell THEN cost END) AS own, arg_min(j, (cost, j)) AS first_ FROM k GROUP BY id)",
        f"{_BASE} ql bl cx cq cells",
        k=f"SELECT b.id, b.cell, k.cell AS j, {_TARGET_COST} + 2 * list_sum(list_transform(list_zip(b.q, k.s), lambda z: CASE WHEN z[1] = 0 THEN 0 ELSE z[1] * ln(z[1] / z[2]) END)) AS cost FROM base b, cells k",
    ),
    "move_delta": sql(
        f"SELECT id, {r('vb - va + sqrt(greatest(sum((m + db - da) * (m + db - da)), 0)) - any_value(norm)', 9)} AS delta FROM (SELECT t.id, i, mm.c, mm.m, norm, b * (bl.v - xb.m) * (ql.p - qb.m) AS db, a * (bl.v - xa.m) * (ql.p - qa.m) AS da, va, vb FROM t, mm, mnorm, bl, ql, cx xa, cx xb, cq qa, cq qb WHERE bl.id = t.id AND bl.dim = mm.i AND ql.id = t.id AND ql.c = mm.c AND xa.cell = t.cell AND xa.dim = mm.i AND xb.cell = t.target AND xb.dim = mm.i AND qa.cell = t.cell AND qa.c = mm.c AND qb.cell = t.target AND qb.c = mm.c) GROUP BY id, va, vb",
        _STATS,
        t=f"SELECT id, cell, target, a, b, a * list_sum(list_transform(list_zip(x, ca), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS va, b * list_sum(list_transform(list_zip(x, cb), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS vb FROM (SELECT base.id, base.cell, (base.cell + 1) % {CELLS} AS target, base.x, p.c AS ca, o.c AS cb, p.n / (p.n - 1) / size.n AS a, o.n / (o.n + 1) / size.n AS b FROM base JOIN cells p ON p.cell = base.cell JOIN cells o ON o.cell = (base.cell + 1) % {CELLS}, size WHERE p.n > 1)",
    ),
    "var_part_m4": _divisive(4),
    "min_scatter_cut": sql(
        f"SELECT n AS below, {r('p')} AS value, {r('gain')} AS gain FROM (SELECT n, p, round(s * s / n + (t - s) * (t - s) / (k - n) - t * t / k, 9) AS gain FROM u, (SELECT count(*) AS k, sum(x[1]) AS t FROM nodes) WHERE n < k) ORDER BY gain DESC, p LIMIT 1",
        "nodes",
        u="SELECT p, sum(k) OVER (ORDER BY p)::BIGINT AS n, sum(k * p) OVER (ORDER BY p) AS s FROM (SELECT x[1] AS p, count(*) AS k FROM nodes GROUP BY ALL)",
    ),
    "smoothed_moments": _soft(f"SELECT id, k::INT AS cell, CASE WHEN k = cell THEN 0.95 + 0.05 / {CELLS} ELSE 0.05 / {CELLS} END::DOUBLE AS w FROM base, range({CELLS}) g(k)", _ALL, {}),
    "prototype_moments": _soft(_PROTO, _ONE_Q, {"cost": PARTS["cost"]}),
    "sparse_moments": _soft(_SPARSE, _ONE_Q, {"cost": PARTS["cost"]}),
    "sinkhorn_k3": _sinkhorn(3),
    "node_weights": sql(f"SELECT id, {r('exp(3 * x[1] - (SELECT max(3 * x[1]) FROM nodes)) / (SELECT sum(exp(3 * x[1] - (SELECT max(3 * x[1]) FROM nodes))) FROM nodes) * (SELECT count(*) FROM nodes)')} AS w FROM nodes", "nodes"),
    "mass_diagnostics": sql(f"SELECT {r('min(m)')} AS min_mass, {r('max(m)')} AS max_mass, {r('1 / sum(m * m)')} AS effective_cells FROM (SELECT count(id) / (SELECT n FROM size) AS m FROM anchors LEFT JOIN near USING (cell) GROUP BY anchors.cell)", "nodes size anchors cost near"),
    "assignment_diagnostics": sql(
        f"SELECT {r('avg((own >= top)::INT)')} AS agreement, {r('avg(entropy)')} AS entropy FROM (SELECT id, max(w) AS top, max(CASE WHEN p.cell = b.cell THEN w END) AS own, -sum(CASE WHEN w = 0 THEN 0 ELSE w * ln(w) END) AS entropy FROM ({_PROTO}) p JOIN base b USING (id) GROUP BY id)",
        f"{_BASE} anchors cost",
    ),
    "split_metrics": sql(
        f"SELECT split, {r('100 * avg((list_position(logits, list_max(logits)) - 1 = y)::INT)')} AS accuracy, {r('-avg(logits[y + 1] - lse)')} AS nll, {r('-avg(list_inner_product(q, list_transform(logits, lambda l: l - lse)))')} AS teacher_ce FROM (SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda l: exp(l - list_max(logits))))) AS lse FROM base) GROUP BY split",
        _BASE,
    ),
    "head_gradient": sql(
        f"SELECT k AS c, dim, {r('avg(err * v)', 9)} AS g FROM (SELECT id, k, p - q[k + 1] AS err FROM sm JOIN base USING (id)) JOIN (SELECT id, unnest(range(1, len(z) + 1)) - 1 AS dim, unnest(z) AS v FROM (SELECT id, list_append(x, 1.0::DOUBLE) AS z FROM base)) USING (id) GROUP BY ALL",
        _BASE,
        lo=f"SELECT b.id, t.id AS k, list_inner_product(b.x, t.x) + 0.1::DOUBLE AS l FROM base b, nodes t WHERE t.id < {CLASSES}",
        sm="SELECT id, k, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY id) AS p FROM (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM lo)",
    ),
    "temperature_curve": sql(
        f"SELECT i AS point, {r('t')} AS t, {r('avg(list_max(s) + ln(list_sum(list_transform(s, lambda l: exp(l - list_max(s))))) - s[y + 1])')} AS ce FROM (SELECT i, t, y, list_transform(logits, lambda l: l / t) AS s FROM base, (SELECT i, 0.05::DOUBLE * pow(400::DOUBLE, i / 60) AS t FROM range(61) g(i)) WHERE split = 'val') GROUP BY i, t",
        _BASE,
    ),
    "joint_seed_score": sql("SELECT * FROM joint", "scores inner_ joint"),
    "seed_pair_check": sql(
        "SELECT candidate, step, count(*) AS found, count(DISTINCT (condensation_seed, student_seed)) AS distinct_pairs, count(*) FILTER (condensation_seed > 2 OR student_seed > 2) AS unexpected, 9::BIGINT AS expected FROM s GROUP BY ALL HAVING found <> 9 OR distinct_pairs <> 9 OR unexpected > 0",
        "scores",
        s="SELECT * FROM scores WHERE NOT (candidate = 'click' AND condensation_seed = 1 AND student_seed = 2 AND step = 100)",
    ),
    "select_winner": sql("SELECT candidate, step, val FROM joint ORDER BY val DESC, step, candidate LIMIT 1", "scores inner_ joint"),
    "best_per_group": sql(f"SELECT candidate, condensation_seed, student_seed, step, {r('val_acc')} AS val_acc FROM scores QUALIFY row_number() OVER (PARTITION BY candidate, condensation_seed ORDER BY round(val_acc, 6) DESC, student_seed, step) = 1", "scores"),
    "paired_delta": sql(f"SELECT candidate, {r('avg(d)')} AS mean_change, {r('stddev_samp(d)')} AS std_change, count(*) AS pairs FROM (SELECT s.candidate, s.val_acc - b.val_acc AS d FROM scores s JOIN scores b USING (condensation_seed, student_seed, step) WHERE b.candidate = 'view') GROUP BY candidate", "scores"),
    "seed_summary": sql(f"SELECT candidate, condensation_seed, {r('avg(val_acc)')} AS mean, {r('stddev_samp(val_acc)')} AS std, {r('stddev_pop(val_acc)')} AS std_pop, count(*) AS n FROM scores GROUP BY ALL", "scores"),
    "boundary_profile": sql(
        f"SELECT value, {r('best')} AS best, CASE WHEN lo = hi THEN 'fixed' WHEN value = lo THEN 'lower' WHEN value = hi THEN 'upper' ELSE 'interior' END AS position FROM t, (SELECT min(value) AS lo, max(value) AS hi FROM t)",
        "scores",
        t="SELECT condensation_seed AS value, max(val_acc) AS best FROM scores GROUP BY ALL",
    ),
    "timing_summary": sql(f"SELECT event_type AS name, n, {r('med')} AS median, {r('sd')} AS std, {r('most')} AS most, {r('max(CASE WHEN event_type = $$view$$ THEN med END) OVER () / med')} AS speedup FROM t".replace("$$", "'"), "", t="SELECT event_type, count(*) AS n, median(value) AS med, stddev_samp(value) AS sd, max(value) AS most FROM events GROUP BY ALL"),
    "running_best": f"SELECT user_id AS run, event_id AS step, {r('best')} AS best, {r('change')} AS change, coalesce(best = lag(best, 10) OVER (PARTITION BY user_id ORDER BY event_id), false) AS plateau FROM (SELECT *, max(value) OVER w AS best, value - lag(value) OVER w AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))",
    "content_digest": "SELECT count(*) AS n, bit_xor(h) AS xor_digest, sum(h % 1000003)::BIGINT AS sum_digest FROM (SELECT ('0x' || md5(c_custkey || '|' || c_nationkey)[1:12])::BIGINT AS h FROM customer)",
    "moment_objective": sql(
        f"SELECT {r('vv')} AS v, {r('norm')} AS m_norm, {r('vv + norm')} AS j FROM (SELECT (SELECT avg(list_inner_product(x, x)) FROM base) - (SELECT sum(n * list_inner_product(c, c)) FROM cells) / (SELECT n FROM size) AS vv, norm FROM mnorm)",
        "nodes xl size oneway edges deg w h1 h2",
        hm="SELECT id, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM h2",
        hz="SELECT id, list(v / (SELECT sqrt(sum(v * v) / (SELECT n FROM size)) FROM hm) ORDER BY dim) AS x FROM hm GROUP BY id",
        zn="SELECT id, hz.x, y, split FROM hz JOIN nodes USING (id)",
        zl="SELECT id, y, split, unnest(range(1, len(x) + 1)) - 1 AS dim, unnest(x) AS v FROM zn",
        zc=f"SELECT z.id, arg_min(a.id, (list_inner_product(a.x, a.x) - 2 * list_inner_product(z.x, a.x), a.id))::INT AS cell FROM zn z, zn a WHERE a.id < {CELLS} GROUP BY z.id",
        cm=PARTS["cm"].replace("xl", "zl"),
        lg=PARTS["lg"].replace("nodes", "zn"),
        base=f"SELECT lg.*, cell, list_transform(logits, lambda l: exp(l - list_max(logits)) / list_sum(list_transform(logits, lambda k: exp(k - list_max(logits))))) AS q FROM lg JOIN zc USING (id)",
        **{k: PARTS[k] for k in ("ql", "bl", "cx", "cq", "cells", "mm", "mnorm")},
    ),
}
