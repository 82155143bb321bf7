"""Queries over encoders, factorised costs, partition families, calibration and evaluation, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.stages import cut
from ..operators import assign, checks, factors, features, graph, heads, moments, partition, soft
from ..sources import views
from .catalog import C, M, base, centres, longs
from .oracles import _BASE, _STATS, _kernel, _soft, r, sql
from .oracles import SQL as _CORE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return add


def weights(rows: int, columns: int, seed: int) -> np.ndarray:
    """A fixed dense matrix that SQL can write too."""
    return np.cos(seed + 3 * np.arange(rows)[:, None] + 5 * np.arange(columns)) / 4


def _times(x: str, rows: int, columns: int, seed: int) -> str:
    return f"list_transform(range({columns}), lambda k: list_sum(list_transform(range({rows}), lambda i: {x}[i + 1] * cos({seed} + 3 * i + 5 * k) / 4)))"


def _long(expression: str, source: str = "base") -> str:
    return f"SELECT id, dim, {r('v')} AS v FROM (SELECT id, unnest(range(1, len(e) + 1)) - 1 AS dim, unnest(e) AS v FROM (SELECT id, {expression} AS e FROM {source}))"


# maps and encoders


@query(sql(_long("list_concat(x, q)"), _BASE))
def assignment_inputs(spark: SparkSession, d: str) -> DataFrame:
    return longs(factors.assignment_inputs(base(spark, d)), "u")


@query(sql(_long(_times("x", 64, 6, 1)), _BASE))
def encoder_linear(spark: SparkSession, d: str) -> DataFrame:
    return longs(factors.mapped(base(spark, d), factors.linear(weights(64, 6, 1))), "h")


_HIDDEN = f"list_transform(list_zip({_times('x', 64, 5, 2)}, range(5)), lambda z: greatest(z[1] + cos(3 + 5 * z[2]) / 4, 0))"


@query(sql(_long(_times("h", 5, 4, 4), f"(SELECT id, {_HIDDEN} AS h FROM base)"), _BASE))
def encoder_mlp(spark: SparkSession, d: str) -> DataFrame:
    return longs(factors.mapped(base(spark, d), factors.hidden(weights(64, 5, 2), weights(1, 5, 3)[0], weights(5, 4, 4))), "h")


@query(sql(f"SELECT b.id, a.cell::BIGINT AS dim, {r('list_inner_product(b.h, a.h) / 2')} AS v FROM h b, (SELECT id AS cell, {_times('x', 64, 4, 6)} AS h FROM nodes WHERE id < {M}) a", "nodes", h=f"SELECT id, {_times('x', 64, 4, 5)} AS h FROM nodes"))
def encoder_dual(spark: SparkSession, d: str) -> DataFrame:
    """A tower for the nodes and one for the anchors."""
    n = views.nodes(spark, d)
    anchors = np.array([row.c for row in centres(n).orderBy("cell").collect()])
    return longs(factors.dual_logits(n, factors.linear(weights(64, 4, 5)), anchors, factors.linear(weights(64, 4, 6))), "logits")


@query(sql(f"SELECT b.id, a.cell::BIGINT AS dim, {r('list_inner_product(b.h, a.h) / (sqrt(4::DOUBLE) * 0.5)')} AS v FROM (SELECT id, {_times('x', 64, 4, 7)} AS h FROM nodes) b, (SELECT id AS cell, {_times('x', 64, 4, 8)} AS h FROM nodes WHERE id < {M}) a", "nodes"))
def attention_assignment(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    anchors = np.array([row.c for row in centres(n).orderBy("cell").collect()])
    return longs(factors.attention_logits(n, anchors, weights(64, 4, 7), weights(64, 4, 8), 0.5), "logits")


@query(
    sql(
        f"SELECT w.src AS id, k AS dim, {r('sum(w * v)')} AS v FROM w JOIN g ON w.dst = g.id GROUP BY ALL",
        "nodes size oneway edges deg w",
        a=f"SELECT id, unnest(range(4)) AS k, unnest({_times('x', 64, 4, 9)}) AS v FROM nodes",
        b="SELECT w.src AS id, k, greatest(sum(w * v), 0) AS v FROM w JOIN a ON w.dst = a.id GROUP BY ALL",
        g="SELECT id, j AS k, sum(v * cos(10 + 3 * b.k + 5 * j) / 4) AS v FROM b, range(3) t(j) GROUP BY ALL",
    )
)
def gcn_forward(spark: SparkSession, d: str) -> DataFrame:
    """Two propagations with a dense layer before each and ReLU between: the student's forward pass."""
    n = views.nodes(spark, d)
    w = cut(graph.symmetric_weights(views.ring_edges(n), nodes=n))
    h = graph.propagate(w, views.long_form(factors.mapped(n, factors.linear(weights(64, 4, 9))), "h"))
    h = graph.gathered(h.withColumn("v", F.greatest("v", F.lit(0.0))))
    out = graph.propagate(w, views.long_form(factors.mapped(h, factors.linear(weights(4, 3, 10))), "h"))
    return out.select("id", F.col("dim").cast("long").alias("dim"), v.rounded("v").alias("v"))


@query(_kernel("rbf"))
def nystrom_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of the Nystrom features of nodes and anchors, which give the kernel back."""
    n = views.nodes(spark, d)
    anchors = n.where(F.col("id") < M)
    phi = factors.nystrom(n, anchors, jitter=1e-13)  # the default shows in the last digits
    side = factors.nystrom(anchors, anchors, jitter=1e-13).agg(F.array_sort(F.collect_list(F.struct("id", "phi"))).alias("cells"))
    found = phi.crossJoin(F.broadcast(side)).select("id", F.transform("cells", lambda c: v.dot(F.col("phi"), c["phi"])).alias("k"))
    return longs(found, "k")


@query()
def principal_projection(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates along the four principal axes; signs are not determined, so squares are returned."""
    return longs(factors.projected(views.nodes(spark, d), 4).withColumn("h", F.transform("h", lambda x: x * x)), "h")


# soft assignments

_LOW_RANK = f"SELECT id, cell, exp(l - max(l) OVER (PARTITION BY id)) / sum(exp(l - top)) OVER (PARTITION BY id) AS w FROM (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM (SELECT id, j::INT AS cell, list_sum(list_transform(range(4), lambda k: u[k + 1] * cos(12 + 3 * j + 5 * k) / 4)) / 2 + CASE WHEN j = cell THEN ln(0.7 + 0.3 / {M}) ELSE ln(0.3 / {M}) END AS l FROM (SELECT id, cell, {_times('x', 64, 4, 11)} AS u FROM base), range({M}) g(j)))"
_ALL = "SELECT id, unnest(range(1, len(a) + 1)) - 1 AS dim, unnest(a) AS v FROM (SELECT id, list_concat([1.0::DOUBLE], x, q) AS a FROM base)"


def _moments_out(m: DataFrame) -> DataFrame:
    return m.select(F.col("cell").cast("int").alias("cell"), F.col("dim").cast("long").alias("dim"), v.rounded("s", 9).alias("s"))


def _low_rank(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    u = n.join(factors.mapped(n, factors.linear(weights(64, 4, 11)), name="u"), "id")
    u = factors.low_rank_logits(u, weights(M, 4, 12), assign.smoothed_logits("cell", M, 0.3))
    return cut(u.withColumn("p", v.softmax("logits")).withColumn("a", F.concat(F.array(F.lit(1.0)), "x", "q")))


@query(_soft(_LOW_RANK, _ALL, {}))
def low_rank_moments(spark: SparkSession, d: str) -> DataFrame:
    return _moments_out(moments.soft_moments(_low_rank(spark, d)))


@query(_soft(_LOW_RANK.replace("AS w FROM", "* (1 + id % 3) AS w FROM", 1), _ALL, {}))
def weighted_moments(spark: SparkSession, d: str) -> DataFrame:
    return _moments_out(moments.weighted_moments(_low_rank(spark, d).withColumn("w", (1 + F.col("id") % 3).cast("double"))))


@query(sql(f"SELECT {r('sum(abs(s - h)) / 2')} AS variation FROM (SELECT cell, sum(w) / (SELECT n FROM size) AS s FROM ({_LOW_RANK}) GROUP BY cell) JOIN (SELECT cell, count(*) / (SELECT n FROM size) AS h FROM base GROUP BY cell) USING (cell)", f"size {_BASE}"))
def mass_variation(spark: SparkSession, d: str) -> DataFrame:
    return moments.mass_variation(_low_rank(spark, d)).select(v.rounded("variation").alias("variation"))


@query(sql(f"SELECT {r('avg(w * ln(w))')} AS entropy FROM (SELECT exp(x[1]) / sum(exp(x[1])) OVER () * count(*) OVER () AS w FROM nodes)", "nodes"))
def weight_entropy(spark: SparkSession, d: str) -> DataFrame:
    w = moments.node_weights(views.nodes(spark, d).select("id", F.element_at("x", 1).alias("logit")))
    return moments.weight_entropy(w).select(v.rounded("entropy").alias("entropy"))


_STEP_WEIGHT, _STEP_SCALE = 1.0, 20.0
#: From p (id, cell, w): the derivative dd of V + |M| by each w, over the nodes.
_SLOPES = {
    "mass": "SELECT cell, sum(w) / (SELECT n FROM size) AS m FROM p GROUP BY cell",
    "sx": "SELECT p.cell, dim, sum(w * v) / (SELECT n FROM size) AS s FROM p JOIN (SELECT id, dim, v FROM bl) USING (id) GROUP BY ALL",
    "sq": "SELECT p.cell, c, sum(w * p.p) / (SELECT n FROM size) AS s FROM (SELECT p.id, p.cell, p.w, ql.c, ql.p FROM p JOIN ql USING (id)) AS p GROUP BY ALL",
    "mo": "SELECT x.dim, x.c, x.m - y.m AS m FROM (SELECT dim, c, avg(v * p) AS m FROM bl JOIN ql USING (id) GROUP BY ALL) x JOIN (SELECT dim, c, sum(sx.s * sq.s / m) AS m FROM sx JOIN sq USING (cell) JOIN mass USING (cell) GROUP BY ALL) y ON x.dim = y.dim AND x.c = y.c",
    "g": "SELECT dim, c, m / (SELECT sqrt(sum(m * m) + 1e-24) FROM mo) AS g FROM mo",
    "gq": "SELECT cell, dim, sum(g * s) AS s FROM g JOIN sq USING (c) GROUP BY ALL",
    "gx": "SELECT cell, c, sum(g * s) AS s FROM g JOIN sx USING (dim) GROUP BY ALL",
    "g0": "SELECT cell, (a + b) / (m * m) AS g FROM (SELECT cell, sum(s * s) AS a FROM sx GROUP BY cell) JOIN (SELECT cell, sum(gx.s * sq.s) AS b FROM gx JOIN sq USING (cell, c) GROUP BY cell) USING (cell) JOIN mass USING (cell)",
    "dd": "SELECT id, cell, (a + b + g) / (SELECT n FROM size) AS dd FROM (SELECT bl.id, sx.cell, sum(-v * (2 * sx.s + gq.s) / m) AS a FROM bl JOIN sx USING (dim) JOIN gq ON gq.cell = sx.cell AND gq.dim = sx.dim JOIN mass ON mass.cell = sx.cell GROUP BY ALL) JOIN (SELECT ql.id, gx.cell, sum(-p * gx.s / m) AS b FROM ql JOIN gx USING (c) JOIN mass ON mass.cell = gx.cell GROUP BY ALL) USING (id, cell) JOIN g0 USING (cell)",
}


@query(
    sql(
        f"SELECT id, cell::BIGINT AS dim, {r('l - %s * w * (dd - sum(w * dd) OVER (PARTITION BY id))' % _STEP_SCALE)} AS v FROM p JOIN dd USING (id, cell)",
        f"size {_BASE} ql bl",
        p=f"SELECT id, k::INT AS cell, CASE WHEN k = cell THEN ln(0.7 + 0.3 / {M}) ELSE ln(0.3 / {M}) END AS l, CASE WHEN k = cell THEN 0.7 + 0.3 / {M} ELSE 0.3 / {M} END::DOUBLE AS w FROM base, range({M}) g(k)",
        **_SLOPES,
    )
)
def soft_gradient_step(spark: SparkSession, d: str) -> DataFrame:
    """Logits after one step of fixed length down the gradient of V + |M| from smoothed hard logits."""
    n = base(spark, d).withColumn("logits", assign.smoothed_logits("cell", M, 0.3))
    size = n.count()
    shape = (M, 1 + 64 + C)
    cross = moments.cross_moment(n).toPandas()
    table = np.zeros((64, C))
    table[cross["i"], cross["c"]] = cross["m"]
    _, gradient = soft.objective_and_gradient(soft.moved_moments(n, size, shape), 0.0, table, _STEP_WEIGHT)
    return longs(soft.stepped(n, gradient / size, _STEP_SCALE), "logits")


# factorised costs


def _scaled_cost(cost: str, parts: str, **more: str) -> str:
    return sql(
        f"SELECT id, j::BIGINT AS dim, {r('l / scale')} AS v FROM cc, (SELECT quantile_disc(gap, 0.5) AS scale FROM (SELECT list_reverse_sort(list(l))[1] - list_reverse_sort(list(l))[2] AS gap FROM cc GROUP BY id) WHERE gap > 0)",
        parts,
        **more,
        c0=cost,
        cc="SELECT id, j, l - avg(l) OVER (PARTITION BY id) AS l FROM c0",
    )


@query(_scaled_cost("SELECT b.id, k.cell AS j, 2 * list_inner_product(b.x, k.c) - list_inner_product(k.c, k.c) AS l FROM base b, cells k", f"{_BASE} ql bl cx cq cells"))
def feature_distance_factors(spark: SparkSession, d: str) -> DataFrame:
    return longs(factors.feature_distance(base(spark, d)), "logits")


_JOINT = {
    "zx": "SELECT id, cell, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM bl",
    "zq": "SELECT id, cell, c + 64 AS dim, p - avg(p) OVER (PARTITION BY c) AS v FROM ql",
    "el": "SELECT id, cell, dim, v / sqrt((SELECT sum(v * v) / (SELECT n FROM size) FROM zx)) AS v FROM zx UNION ALL SELECT id, cell, dim, v * sqrt(0.5 / (SELECT sum(v * v) / (SELECT n FROM size) FROM zq)) FROM zq",
    "ev": "SELECT id, cell, list(v ORDER BY dim) AS e FROM el GROUP BY ALL",
    "ec": "SELECT cell, list(m ORDER BY dim) AS c FROM (SELECT cell, dim, avg(v) AS m FROM el GROUP BY ALL) GROUP BY cell",
}


@query(_scaled_cost("SELECT b.id, k.cell AS j, 2 * list_inner_product(b.e, k.c) - list_inner_product(k.c, k.c) AS l FROM ev b, ec k", f"size {_BASE} ql bl", **_JOINT))
def label_distance_factors(spark: SparkSession, d: str) -> DataFrame:
    """The same on the joint embedding of features and labels."""
    return longs(factors.feature_distance(cut(features.joint_embedding(base(spark, d), 0.5)), "e"), "logits")


_GS = "SELECT cell, list(v ORDER BY i) AS gs FROM (SELECT cells.cell, i, sum(mm.m / norm * cq.m) AS v FROM (SELECT i, c, mm.m, norm FROM mm, mnorm) AS mm JOIN cq USING (c) JOIN cells ON cells.cell = cq.cell GROUP BY ALL) GROUP BY cell"
_GC = "SELECT cell, list(v ORDER BY c) AS gc FROM (SELECT cx.cell, mm.c, sum(mm.m / norm * cx.m) AS v FROM mm, mnorm, cx WHERE cx.dim = mm.i GROUP BY ALL) GROUP BY cell"


@query(_scaled_cost("SELECT b.id, k.cell AS j, 2 * list_inner_product(b.x, k.c) + list_inner_product(b.x, gs) + list_inner_product(b.q, gc) - list_inner_product(k.c, k.c) - list_inner_product(gc, k.s) AS l FROM base b, cells k JOIN gs USING (cell) JOIN gc USING (cell)", _STATS, gs=_GS, gc=_GC))
def moment_cost_factors(spark: SparkSession, d: str) -> DataFrame:
    return longs(factors.moment_cost(base(spark, d), 1.0), "logits")


def _uniform(*parts: str) -> str:
    return f"((('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:12])::BIGINT)::DOUBLE + 0.5) / {1 << 48}::DOUBLE"


_COSTS = f"SELECT id, cell, d - avg(d) OVER (PARTITION BY id) AS d FROM (SELECT id, j AS cell, sqrt(-2 * ln({_uniform(chr(39) + 'r' + chr(39), '0', 'id', 'j')})) * cos(2 * pi() * {_uniform(chr(39) + 'a' + chr(39), '0', 'id', 'j')}) AS d FROM nodes, range({M}) g(j))"


@query(sql(f"SELECT id, cell AS dim, {r('-d / (SELECT sqrt(avg(d * d)) FROM z) / 0.5::DOUBLE')} AS v FROM z", "nodes", z=_COSTS))
def random_cost_base(spark: SparkSession, d: str) -> DataFrame:
    return longs(factors.random_costs(views.nodes(spark, d), M, 0.5), "logits")


@query(sql(f"SELECT id, ((row_number() OVER (ORDER BY md5(concat_ws(':', id, 0)), id) - 1) % {M})::INT AS cell FROM nodes", "nodes"))
def random_balanced_start(spark: SparkSession, d: str) -> DataFrame:
    return factors.random_balanced(views.nodes(spark, d), M).select("id", "cell")


# transforms that are kept


@query(_CORE["rms_features_train"])
def saved_transform(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on training rows, cut off as a table of one row, applied to all."""
    n = views.nodes(spark, d)
    return longs(features.apply_rms(n, cut(features.fitted_rms(n.where("split = 'train'")))))


@query(_CORE["cell_means"])
def decoded_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Representatives of scaled features, back in the features' own units."""
    n = base(spark, d)
    fitted = cut(features.fitted_rms(n))
    cells = features.undo_rms(moments.means(features.apply_rms(n, fitted), "x", "c"), fitted, "c")
    return cells.select("cell", F.posexplode("c").alias("dim", "v")).select("cell", F.col("dim").cast("long").alias("dim"), v.rounded("v").alias("v"))


@query(sql(_long("list_transform(x, lambda a: a / list_sum(list_transform(x, lambda b: abs(b))))", "nodes"), "nodes"))
def unit_sum_rows(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.unit_sum(views.nodes(spark, d)))


# partition families


def _target(rows: str, cells: str, extra: str = "") -> dict[str, str]:
    return {"k": f"SELECT b.id, b.cell, k.cell AS j, list_inner_product(k.c, k.c) - 2 * list_inner_product(b.e, k.c){extra} AS cost FROM {rows} b, {cells} k"}


_PICK = "SELECT id, CASE WHEN own <= low THEN cell ELSE first_ END AS target FROM (SELECT id, any_value(cell) AS cell, min(cost) AS low, min(CASE WHEN j = cell THEN cost END) AS own, arg_min(j, (cost, j)) AS first_ FROM k GROUP BY id)"


@query(sql(_PICK, f"size {_BASE} bl cx", **{"ec": "SELECT cell, list(m ORDER BY dim) AS c FROM cx GROUP BY cell", "ev": "SELECT id, cell, x AS e FROM base"}, **_target("ev", "ec")))
def variance_sweep(spark: SparkSession, d: str) -> DataFrame:
    return partition.variance_sweep(base(spark, d), "x").select("id", "target")


@query(sql(_PICK, f"size {_BASE} ql bl", **_JOINT, **_target("ev", "ec")))
def normalized_variance_sweep(spark: SparkSession, d: str) -> DataFrame:
    return partition.variance_sweep(cut(features.joint_embedding(base(spark, d), 0.5)), "e").select("id", "target")


@query(sql(_PICK, f"size {_BASE}", ev="SELECT id, cell, list_concat(list_transform(x, lambda a: a * sqrt(2::DOUBLE)), list_transform(q, lambda a: a * sqrt(3::DOUBLE))) AS e FROM base", ec="SELECT cell, list(m ORDER BY dim) AS c FROM (SELECT cell, dim, avg(v) AS m FROM (SELECT cell, unnest(range(len(e))) AS dim, unnest(e) AS v FROM ev) GROUP BY ALL) GROUP BY cell", **_target("ev", "ec")))
def variance_sum_sweep(spark: SparkSession, d: str) -> DataFrame:
    """2 V + 3 V_q, on raw features and labels."""
    n = base(spark, d).withColumn("e", F.concat(v.scaled("x", F.sqrt(F.lit(2.0))), v.scaled("q", F.sqrt(F.lit(3.0)))))
    return partition.variance_sweep(cut(n), "e").select("id", "target")


def _divergence_sweeps(sweeps: int) -> str:
    steps = {"a0": "SELECT id, x, q, cell FROM base"}
    for k in range(sweeps):
        steps[f"x{k}"] = f"SELECT cell, list(m ORDER BY dim) AS c FROM (SELECT cell, dim, avg(v) AS m FROM (SELECT cell, unnest(range(len(x))) AS dim, unnest(x) AS v FROM a{k}) GROUP BY ALL) GROUP BY cell"
        steps[f"q{k}"] = f"SELECT cell, list(m ORDER BY dim) AS s FROM (SELECT cell, dim, avg(v) AS m FROM (SELECT cell, unnest(range(len(q))) AS dim, unnest(q) AS v FROM a{k}) GROUP BY ALL) GROUP BY cell"
        steps[f"k{k}"] = f"SELECT b.id, b.cell, j.cell AS j, list_inner_product(j.c, j.c) - 2 * list_inner_product(b.x, j.c) + 2 * list_sum(list_transform(list_zip(b.q, s.s), lambda z: CASE WHEN z[1] = 0 THEN 0 ELSE z[1] * ln(z[1] / z[2]) END)) AS cost FROM a{k} b, x{k} j JOIN q{k} s ON s.cell = j.cell"
        steps[f"a{k + 1}"] = f"SELECT a.id, x, q, t.target AS cell FROM a{k} a JOIN ({_PICK.replace('FROM k GROUP', f'FROM k{k} GROUP')}) t ON a.id = t.id"
    return sql(f"SELECT id, cell FROM a{sweeps}", _BASE, **steps).replace(" AS (", " AS MATERIALIZED (")


@query(_divergence_sweeps(2))
def divergence_partition(spark: SparkSession, d: str) -> DataFrame:
    """Two sweeps of the loop on V + 2 KL."""
    return partition.divergence_partition(base(spark, d), M, 2.0, most_sweeps=2)[0].select("id", "cell")


@query()
def variance_partition(spark: SparkSession, d: str) -> DataFrame:
    """The loop on the joint embedding until it settles."""
    return partition.variance_partition_loop(cut(features.joint_embedding(base(spark, d), 0.5)), M, "e")[0].select("id", "cell")


@query()
def principal_split(spark: SparkSession, d: str) -> DataFrame:
    return partition.principal_split(views.nodes(spark, d), 4).select("id", "cell")


@query()
def principal_scatter_split(spark: SparkSession, d: str) -> DataFrame:
    return partition.principal_split(views.nodes(spark, d), 4, least_scatter=True).select("id", "cell")


@query(
    sql(
        f"SELECT {r('vv')} AS v, {r('vv + 2 * (sqrt(norm * norm + 0.01) - 0.1)')} AS j FROM (SELECT (SELECT avg(list_inner_product(x, x)) FROM base) - (SELECT sum(n * list_inner_product(c, c)) FROM cells) / (SELECT n FROM size) AS vv, norm FROM mnorm)",
        _STATS,
    )
)
def smooth_objective(spark: SparkSession, d: str) -> DataFrame:
    return moments.smooth_objective(base(spark, d), 2.0, 0.1).select(v.rounded("v").alias("v"), v.rounded("j").alias("j"))


# calibration and evaluation


def _calibration(low: float, high: float, log_scale: bool, rounds: int = 8, points: int = 33) -> str:
    """The same nested grids, unrolled."""
    to_t = "exp(u)" if log_scale else "1 / u"
    a, b = (f"ln({low}::DOUBLE)", f"ln({high}::DOUBLE)") if log_scale else (f"1 / {high}::DOUBLE", f"1 / {low}::DOUBLE")
    ce = "avg(list_max(s) + ln(list_sum(list_transform(s, lambda l: exp(l - list_max(s))))) - s[y + 1])"
    steps = {"val_": "SELECT logits, y FROM base WHERE split = 'val'", "b0": f"SELECT {a} AS lo, {b} AS hi"}
    for k in range(rounds):
        steps[f"u{k}"] = f"SELECT i, lo + (hi - lo) * i / {points - 1} AS u FROM b{k}, range({points}) g(i)"
        steps[f"c{k}"] = f"SELECT i, u, {ce} AS ce FROM (SELECT i, u, y, list_transform(logits, lambda l: l / ({to_t})) AS s FROM val_, u{k}) GROUP BY i, u"
        steps[f"b{k + 1}"] = f"SELECT (SELECT u FROM u{k} WHERE i = greatest(0, best - 1)) AS lo, (SELECT u FROM u{k} WHERE i = least({points - 1}, best + 1)) AS hi FROM (SELECT arg_min(i, (ce, i)) AS best FROM c{k})"
    steps["cand"] = f"SELECT 0 AS place, {a} AS u UNION ALL SELECT 1, {b} UNION ALL SELECT 2, (lo + hi) / 2 FROM b{rounds} UNION ALL SELECT 3, {0.0 if log_scale else 1.0}"
    steps["loss"] = f"SELECT place, u, {ce} AS ce FROM (SELECT place, u, y, list_transform(logits, lambda l: l / ({to_t})) AS s FROM val_, cand) GROUP BY place, u"
    text = sql(f"SELECT round({to_t}, 4) AS t, {r('ce')} AS ce, (SELECT {r('ce')} FROM loss WHERE place = 3) AS ce_before FROM loss ORDER BY round(ce, 12), place LIMIT 1", _BASE, **steps)
    return text.replace(" AS (", " AS MATERIALIZED (")


@query(_calibration(0.05, 20.0, False))
def calibrated_temperature(spark: SparkSession, d: str) -> DataFrame:
    found, _ = heads.calibrated_temperature(base(spark, d))
    return found.select(F.round("t", 4).alias("t"), v.rounded("ce").alias("ce"), v.rounded("ce_before").alias("ce_before"))


@query(_calibration(0.01, 100.0, True))
def calibrated_log_temperature(spark: SparkSession, d: str) -> DataFrame:
    found, _ = heads.calibrated_temperature(base(spark, d), 0.01, 100.0, log_scale=True)
    return found.select(F.round("t", 4).alias("t"), v.rounded("ce").alias("ce"), v.rounded("ce_before").alias("ce_before"))


@query(
    f"WITH m AS ({_CORE['split_metrics']}) SELECT "
    + ", ".join(f"max(CASE WHEN split = '{s}' THEN {c} END) AS {s}_{c}" for s in ("train", "val", "test") for c in ("accuracy", "nll"))
    + f", max(CASE WHEN split = 'train' THEN teacher_ce END) AS train_teacher_ce, {r('max(CASE WHEN split = $val$ THEN nll END) - max(CASE WHEN split = $train$ THEN nll END)')} AS val_minus_train_nll, {r('max(CASE WHEN split = $train$ THEN accuracy END) - max(CASE WHEN split = $val$ THEN accuracy END)')} AS train_minus_val_accuracy FROM m".replace("$", "'")
)
def split_gaps(spark: SparkSession, d: str) -> DataFrame:
    m = moments.split_metrics(base(spark, d)).select("split", *[v.rounded(c).alias(c) for c in ("accuracy", "nll", "teacher_ce")])
    g = moments.split_gaps(m)
    return g.withColumns({c: v.rounded(c) for c in ("val_minus_train_nll", "train_minus_val_accuracy")})


@query(f"SELECT split AS graph_id, accuracy, nll, CASE WHEN split = 'train' THEN teacher_ce END AS teacher_ce FROM ({_CORE['split_metrics']})")
def inductive_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each split as a graph of its own; only the training graph has teacher labels."""
    m = moments.inductive_metrics(base(spark, d).withColumnRenamed("split", "graph_id"))
    return m.select("graph_id", *[v.rounded(c).alias(c) for c in ("accuracy", "nll", "teacher_ce")])


@query(sql(f"SELECT {r('avg(lse * list_sum(q) - list_inner_product(q, l))')} AS ce FROM (SELECT q, l, list_max(l) + ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) AS lse FROM (SELECT b.id, any_value(b.q) AS q, list(list_inner_product(b.x, t.x) + 0.1::DOUBLE ORDER BY t.id) AS l FROM base b, nodes t WHERE t.id < {C} GROUP BY b.id))", _BASE))
def outer_value(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    theta = n.where(F.col("id") < C).select(F.col("id").cast("int").alias("cell"), F.concat("x", F.array(F.lit(0.1))).alias("c"))
    return moments.outer_value(n, theta).select(v.rounded("ce").alias("ce"))


@query(sql(f"SELECT {r('sqrt(sum((a.v - b.v) * (a.v - b.v))) / greatest(sqrt(sum(b.v * b.v)), 1e-12)')} AS e, a.cell FROM (SELECT cell, dim, avg(v) AS v FROM bl GROUP BY ALL) a JOIN (SELECT dim, avg(v) AS v FROM bl GROUP BY ALL) b USING (dim) GROUP BY a.cell", f"{_BASE} bl"))
def relative_error(spark: SparkSession, d: str) -> DataFrame:
    """Of each cell's mean to the mean of all."""
    n = base(spark, d)
    rows = moments.means(n, "x", "c").crossJoin(F.broadcast(features.mean_vector(n)))
    return rows.select("cell", v.rounded(checks.relative_error(F.col("c"), F.col("mean"))).alias("e"))


@query(sql("SELECT split, count(*) AS n, bit_xor(('0x' || md5(id || '|' || y)[1:12])::BIGINT) AS xor_digest, sum(('0x' || md5(id || '|' || y)[1:12])::BIGINT % 1000003)::BIGINT AS sum_digest FROM nodes GROUP BY split", "nodes"))
def split_digests(spark: SparkSession, d: str) -> DataFrame:
    """The content digest of each split's graph."""
    from ..operators import selection

    n = views.nodes(spark, d)
    parts = [selection.content_digest(n.where(F.col("split") == s), ["id", "y"]).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return reduce(DataFrame.union, parts)

