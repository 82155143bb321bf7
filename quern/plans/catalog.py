"""The registered queries: each reads the test tables, applies operators and returns flat rounded columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.stages import cut
from ..operators import assign, features, graph, heads, moments, partition, selection, soft
from ..sources import views

M, C = views.CELLS, views.CLASSES
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def base(spark: SparkSession, d: str) -> DataFrame:
    """nodes with class-mean logits, soft labels q at temperature 1 and cell = id mod 8."""
    n = features.soft_labels(features.class_mean_logits(views.nodes(spark, d)))
    return cut(n.withColumn("cell", (F.col("id") % M).cast("int")))


def longs(n: DataFrame, vector: str = "x") -> DataFrame:
    return n.select("id", F.posexplode(vector).alias("dim", "v")).select("id", F.col("dim").cast("long").alias("dim"), v.rounded("v").alias("v"))


def centres(n: DataFrame) -> DataFrame:
    return partition.first_centres(n, M)


# graph


@query
def s2x_propagation(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    w = cut(graph.symmetric_weights(views.ring_edges(n), nodes=n))
    return longs(graph.propagate_vectors(w, n, hops=2))


@query
def sym_norm_degree(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return graph.symmetric_weights(views.ring_edges(n), nodes=n).select("src", "dst", v.rounded("w", 9).alias("w"))


@query
def gcn_norm(spark: SparkSession, d: str) -> DataFrame:
    """Loops added where missing: the ring without loops on odd nodes."""
    n = views.nodes(spark, d)
    e = views.ring_edges(n).where("src <> dst or src % 2 = 0")
    return graph.symmetric_weights(e, "missing", n).select("src", "dst", v.rounded("w", 9).alias("w"))


@query
def symmetrise_edges(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    one_way = n.crossJoin(F.broadcast(n.agg(F.count("*").alias("n")))).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % F.col("n")).alias("dst"))
    return views.undirected(one_way)


@query
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return views.induced_subgraph(n, views.ring_edges(n), "val")


@query
def split_roles(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    roles = n.where("split <> 'test'").select("id", F.when(F.col("split") == "train", "tr").otherwise("va").alias("role"))
    return views.split_of_roles(n.select("id"), roles)


@query
def dense_labels(spark: SparkSession, d: str) -> DataFrame:
    return views.dense_labels(views.nodes(spark, d).select("id", (F.col("y") + 4).alias("label")))


@query
def push_operator(spark: SparkSession, d: str) -> DataFrame:
    return graph.push_weights(views.ring_edges(views.nodes(spark, d))).select("src", "dst", v.rounded("w", 9).alias("w"))


@query
def push_labels_k3(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    w = cut(graph.push_weights(views.ring_edges(n)))
    p = F.when(F.col("split") == "train", v.one_hot("y", C)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(C)), lambda _: F.lit(1.0 / C)))
    source = cut(n.select("id", F.posexplode(p).alias("c", "p")))
    q = source
    for _ in range(3):
        q = graph.push_step(w, source, q, 0.8)
    return q.select("id", F.col("c").cast("long").alias("c"), v.rounded("p").alias("p"))


@query
def knn_train(spark: SparkSession, d: str) -> DataFrame:
    found = graph.nearest_train(views.nodes(spark, d), 5)
    return found.select("id", "other", F.col("rank").cast("long").alias("rank"), v.rounded("d2").alias("d2"))


@query
def kernel_labels(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    p = assign.kernel_labels(graph.nearest_train(n, 5), n, C, 0.8, 0.5)
    return p.select("id", F.col("c").cast("long").alias("c"), v.rounded("p").alias("p"))


# features


@query
def train_zscore(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.train_zscore(views.nodes(spark, d)))


@query
def rms_features(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.rms_features(views.nodes(spark, d)))


@query
def rms_features_train(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return longs(features.rms_features(n, of=n.where("split = 'train'")))


@query
def l2_features(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.unit_features(views.nodes(spark, d)))


@query
def joint_embedding(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.joint_embedding(base(spark, d), 0.5), "e")


@query
def bound_embedding(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.bound_embedding(base(spark, d), 0.5), "e")


def _kernel(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        n = views.nodes(spark, d)
        return longs(features.kernel_values(n, n.where(F.col("id") < M), kind), "k")

    return run


for _kind in ("rbf", "linear", "erf", "relu", "relu2"):
    QUERIES[f"{_kind}_kernel_anchors"] = _kernel(_kind)


@query
def soft_labels_t(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.soft_labels(features.class_mean_logits(views.nodes(spark, d)), 0.7), "q")


@query
def adaptive_temperature(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    near = graph.nearest_train(n, 5).where("rank = 5").select("id", F.col("d2").alias("d"))
    t = features.adaptive_temperature(n.select("id", "split").join(near, "id"), 0.8, 1.5)
    return t.select("id", v.rounded("position").alias("position"), v.rounded("t").alias("t"))


# assignment


@query
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return assign.nearest_cell(n, centres(n)).select("id", "cell")


@query
def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    fresh = partition.lloyd_step(n, centres(n))
    return fresh.select("cell", F.posexplode("c").alias("dim", "v")).select("cell", F.col("dim").cast("long").alias("dim"), v.rounded("v").alias("v"))


@query
def sparse_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    c = assign.sparse_candidates(n, centres(n), 3, 0.05)
    return c.select("id", F.explode(F.arrays_zip("cand", "p")).alias("e")).select("id", F.col("e.cand").cast("int").alias("cell"), v.rounded("e.p").alias("p"))


@query
def distance_gap_scale(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return longs(assign.gap_scaled_logits(n, centres(n)).withColumn("logits", F.transform("logits", lambda x: x - F.array_max("logits"))), "logits")


@query
def distance_base_raw(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return longs(assign.distance_base(n, centres(n), 0.5, False), "logits")


@query
def distance_base_normalised(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    return longs(assign.distance_base(n, centres(n), 0.5, True), "logits")


# moments


@query
def cell_means(spark: SparkSession, d: str) -> DataFrame:
    m = moments.means(base(spark, d), "x", "c")
    return m.select("cell", F.posexplode("c").alias("dim", "v")).select("cell", F.col("dim").cast("long").alias("dim"), v.rounded("v").alias("v"))


@query
def cell_statistics(spark: SparkSession, d: str) -> DataFrame:
    cells = moments.representatives(base(spark, d))
    return cells.select("cell", "n", v.rounded(v.squared_norm("c")).alias("c2"), v.rounded(v.squared_norm("s")).alias("s2"))


@query
def empty_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return moments.counts(base(spark, d).withColumn("cell", F.col("cell") * 2), 2 * M)


@query
def moment_objective(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: propagated features, RMS scale, nearest anchors, then V, |M| and J."""
    n = views.nodes(spark, d)
    w = cut(graph.symmetric_weights(views.ring_edges(n), nodes=n))
    h = cut(graph.propagate_vectors(w, n, hops=2).join(n.select("id", "y", "split"), "id"))
    z = cut(features.rms_features(h))
    z = features.soft_labels(features.class_mean_logits(assign.nearest_cell(z, centres(z))))
    return moments.moment_objective(cut(z), 1.0).select(*[v.rounded(c).alias(c) for c in ("v", "m_norm", "j")])


@query
def cross_moment(spark: SparkSession, d: str) -> DataFrame:
    return moments.cross_moment(base(spark, d)).select(F.col("i").cast("long").alias("i"), F.col("c").cast("long").alias("c"), v.rounded("m", 9).alias("m"))


@query
def kl_objective(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    cells = moments.representatives(n)
    both = moments.within_variance(n, cells, "x", "c").crossJoin(moments.label_divergence(n))
    return both.select(v.rounded("variance").alias("v"), v.rounded("kl", 9).alias("kl"), v.rounded(F.col("variance") + 2 * F.col("kl")).alias("j"))


@query
def normalized_variance_objective(spark: SparkSession, d: str) -> DataFrame:
    n = features.centred(features.centred(base(spark, d)), "q")
    n = cut(n)
    energy = n.agg(F.avg(v.squared_norm("x")).alias("gx"), F.avg(v.squared_norm("q")).alias("gq"))
    cells = moments.representatives(n)
    vx = moments.within_variance(n, cells, "x", "c").withColumnRenamed("variance", "vx")
    vq = moments.within_variance(n, cells, "q", "s").withColumnRenamed("variance", "vq")
    return energy.crossJoin(vx).crossJoin(vq).select(v.rounded(F.col("vx") / F.col("gx") + 0.5 * F.col("vq") / F.col("gq")).alias("j"))


@query
def moment_cost_proposal(spark: SparkSession, d: str) -> DataFrame:
    return partition.moment_proposal(base(spark, d), 1.0).select("id", "target")


@query
def divergence_proposal(spark: SparkSession, d: str) -> DataFrame:
    return partition.divergence_proposal(base(spark, d), 2.0).select("id", "target")


@query
def move_delta(spark: SparkSession, d: str) -> DataFrame:
    deltas = partition.move_deltas(base(spark, d), 1.0, (F.col("cell") + 1) % M)
    return deltas.select("id", v.rounded("delta", 9).alias("delta"))


@query
def var_part_m4(spark: SparkSession, d: str) -> DataFrame:
    return partition.divisive(views.nodes(spark, d), 4).select("id", "cell")


@query
def min_scatter_cut(spark: SparkSession, d: str) -> DataFrame:
    points = views.nodes(spark, d).select("id", F.get("x", F.lit(0)).alias("p"))
    return partition.scatter_cut(points).select("below", v.rounded("value").alias("value"), v.rounded("gain").alias("gain"))


def _moments_out(m: DataFrame) -> DataFrame:
    return m.select(F.col("cell").cast("int").alias("cell"), F.col("dim").cast("long").alias("dim"), v.rounded("s", 9).alias("s"))


@query
def smoothed_moments(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d).withColumn("p", v.softmax(assign.smoothed_logits("cell", M, 0.05))).withColumn("a", F.concat(F.array(F.lit(1.0)), "x", "q"))
    return _moments_out(moments.soft_moments(n))


@query
def prototype_moments(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    n = assign.prototype_logits(n, centres(n), 0.3).withColumn("p", v.softmax("logits")).withColumn("a", F.concat(F.array(F.lit(1.0)), "q"))
    return _moments_out(moments.soft_moments(n))


@query
def sparse_moments(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    c = assign.sparse_candidates(n, centres(n), 3, 0.05).join(n.select("id", F.concat(F.array(F.lit(1.0)), "q").alias("a")), "id")
    return _moments_out(moments.sparse_moments(c))


@query
def sinkhorn_k3(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    n = cut(assign.prototype_logits(n, centres(n), 0.3))
    return longs(assign.balanced(n, M, 3), "p")


@query
def node_weights(spark: SparkSession, d: str) -> DataFrame:
    w = moments.node_weights(views.nodes(spark, d).select("id", (3 * F.element_at("x", 1)).alias("logit")))
    return w.select("id", v.rounded("w").alias("w"))


@query
def mass_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    m = moments.mass_diagnostics(moments.counts(assign.nearest_cell(n, centres(n)), M))
    return m.select(*[v.rounded(c).alias(c) for c in ("min_mass", "max_mass", "effective_cells")])


@query
def assignment_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    p = assign.prototype_logits(n, centres(n), 0.3).withColumn("p", v.softmax("logits"))
    own = F.element_at("p", F.col("cell") + 1) >= F.array_max("p")
    return p.agg(v.rounded(F.avg(own.cast("double"))).alias("agreement"), v.rounded(F.avg(-v.total(F.transform("p", lambda x: v.xlogy(x, x))))).alias("entropy"))


@query
def split_metrics(spark: SparkSession, d: str) -> DataFrame:
    return moments.split_metrics(base(spark, d)).select("split", *[v.rounded(c).alias(c) for c in ("accuracy", "nll", "teacher_ce")])


@query
def head_gradient(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d)
    theta = n.where(F.col("id") < C).select(F.col("id").cast("int").alias("cell"), F.concat("x", F.array(F.lit(0.1))).alias("c"))
    return moments.head_gradient(n, theta).select(F.col("c").cast("long").alias("c"), F.col("dim").cast("long").alias("dim"), v.rounded("g", 9).alias("g"))


@query
def temperature_curve(spark: SparkSession, d: str) -> DataFrame:
    return heads.temperature_curve(base(spark, d)).select(F.col("point").cast("long").alias("point"), v.rounded("t").alias("t"), v.rounded("ce").alias("ce"))


# score algebra


@query
def joint_seed_score(spark: SparkSession, d: str) -> DataFrame:
    s = selection.joint_score(views.scores(spark, d))
    return s.select("candidate", "step", *[v.rounded(c).alias(c) for c in ("val", "val_std", "student_std")], "evaluations")


@query
def seed_pair_check(spark: SparkSession, d: str) -> DataFrame:
    """One row short on purpose: the group that misses it is reported."""
    s = views.scores(spark, d).where("not (candidate = 'click' and condensation_seed = 1 and student_seed = 2 and step = 100)")
    return selection.missing_pairs(s, [0, 1, 2], [0, 1, 2])


@query
def select_winner(spark: SparkSession, d: str) -> DataFrame:
    s = selection.joint_score(views.scores(spark, d)).withColumn("val", v.rounded("val"))
    return selection.best(s, [F.desc("val"), "step", "candidate"]).select("candidate", "step", "val")


@query
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    s = views.scores(spark, d).withColumn("val_acc", v.rounded("val_acc"))
    return selection.best(s, [F.desc("val_acc"), "student_seed", "step"], ["candidate", "condensation_seed"]).select("candidate", "condensation_seed", "student_seed", "step", "val_acc")


@query
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    p = selection.paired_change(views.scores(spark, d), "view", ["condensation_seed", "student_seed", "step"])
    return p.select("candidate", v.rounded("mean_change").alias("mean_change"), v.rounded("std_change").alias("std_change"), "pairs")


@query
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    s = views.scores(spark, d)
    return s.groupBy("candidate", "condensation_seed").agg(v.rounded(F.avg("val_acc")).alias("mean"), v.rounded(F.stddev_samp("val_acc")).alias("std"), v.rounded(F.stddev_pop("val_acc")).alias("std_pop"), F.count("*").alias("n"))


@query
def boundary_profile(spark: SparkSession, d: str) -> DataFrame:
    return selection.boundary_profile(views.scores(spark, d), "condensation_seed").select("value", v.rounded("best").alias("best"), "position")


@query
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"))
    return selection.timing_summary(runs, "view").select("name", "n", *[v.rounded(c).alias(c) for c in ("median", "std", "most", "speedup")])


@query
def running_best(spark: SparkSession, d: str) -> DataFrame:
    h = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")
    return selection.running_best(h, "run", "step", "value").select("run", "step", v.rounded("best").alias("best"), v.rounded("change").alias("change"), "plateau")


@query
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return selection.content_digest(spark.read.parquet(f"{d}/customer.parquet"), ["c_custkey", "c_nationkey"])


# rows only: iterative or fitted


@query
def lloyd_full(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    placed, _ = partition.lloyd(n, partition.spread_centres(n, M), 20)
    return placed.select("id", "cell")


@query
def moment_partition(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps until nothing moves or 20 are made, with the status."""
    placed, _, status = partition.moment_partition(base(spark, d), 1.0)
    return placed.select("id", "cell", F.lit(status).alias("status"))


@query
def whiten(spark: SparkSession, d: str) -> DataFrame:
    return longs(features.whitened(views.nodes(spark, d)))


@query
def head_fit(spark: SparkSession, d: str) -> DataFrame:
    theta, _ = heads.fit_head(moments.representatives(base(spark, d)), 0.1)
    return spark.createDataFrame([(c, k, round(x, 4)) for c, row in enumerate(theta) for k, x in enumerate(row)], "c int, dim int, theta double")


#: Basis nodes of the kernel teacher, drawn by hash from the training nodes.
BASIS = 64


@query
def kernel_teacher(spark: SparkSession, d: str) -> DataFrame:
    n = views.nodes(spark, d)
    basis = n.where("split = 'train'").orderBy(F.md5(F.col("id").cast("string"))).limit(BASIS)
    k = features.kernel_values(n, cut(basis), "relu")
    fitted = features.soft_labels(heads.kernel_teacher(k, n, 0.1))
    return moments.split_metrics(fitted).select("split", *[F.round(c, 3).alias(c) for c in ("accuracy", "nll", "teacher_ce")])


@query
def soft_partition(spark: SparkSession, d: str) -> DataFrame:
    """Descent on the smooth objective from smoothed hard logits, as the cell of largest logit."""
    n = base(spark, d).withColumn("logits", assign.smoothed_logits("cell", M, 0.3))
    moved, _ = soft.descend(n.select("id", "x", "q", "logits"), 1.0)
    return moved.select("id", (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("cell"))
