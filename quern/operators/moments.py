"""Additive cell statistics: partial sums in each task, one shuffle of cells x dimensions rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v


def all_cells(spark: SparkSession, cells: int) -> DataFrame:
    return spark.range(cells).select(F.col("id").cast("int").alias("cell"))


def counts(n: DataFrame, cells: int) -> DataFrame:
    """(cell, n) for every cell, empty ones with 0."""
    own = n.groupBy("cell").agg(F.count("*").alias("n"))
    return all_cells(n.sparkSession, cells).join(own, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


def means(n: DataFrame, vector: str, name: str) -> DataFrame:
    """(cell, mean vector) of the cells that have nodes."""
    per = n.select("cell", F.posexplode(vector).alias("dim", "v")).groupBy("cell", "dim").agg(F.avg("v").alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"])
    return per.groupBy("cell").agg(ordered.alias(name))


def representatives(n: DataFrame) -> DataFrame:
    """(cell, n, c, s): size, mean x and mean q of each cell, in one aggregation."""
    per = n.select("cell", F.size("x").alias("d"), F.posexplode(F.concat("x", "q")).alias("dim", "v")).groupBy("cell", "dim").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.max("d").alias("d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"])
    whole = per.groupBy("cell").agg(F.max("n").alias("n"), F.max("d").alias("d"), ordered.alias("a"))
    return whole.select("cell", "n", F.slice("a", F.lit(1), F.col("d")).alias("c"), F.slice("a", F.col("d") + 1, F.size("a")).alias("s"))


def cross_moment(n: DataFrame) -> DataFrame:
    """(i, c, m) with m = mean of x_i q_c."""
    pairs = n.select(F.posexplode("x").alias("i", "a"), "q").select("i", "a", F.posexplode("q").alias("c", "b"))
    return pairs.groupBy("i", "c").agg(F.avg(F.col("a") * F.col("b")).alias("m"))


def residual_moment(n: DataFrame, cells: DataFrame) -> DataFrame:
    """(i, c, m): the cross moment less its part between cells, sum_j n_j c_j s_j' / N."""
    size = cells.agg(F.sum("n").alias("total"))
    between = cells.crossJoin(F.broadcast(size)).select((F.col("n") / F.col("total")).alias("w"), F.posexplode("c").alias("i", "a"), "s")
    between = between.select("w", "i", "a", F.posexplode("s").alias("c", "b")).groupBy("i", "c").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("between"))
    return cross_moment(n).join(between, ["i", "c"]).select("i", "c", (F.col("m") - F.col("between")).alias("m"))


def within_variance(n: DataFrame, cells: DataFrame, vector: str, centre: str) -> DataFrame:
    """One value: mean |x|^2 - sum_j n_j |c_j|^2 / N."""
    energy = n.agg(F.avg(v.squared_norm(vector)).alias("energy"), F.count("*").alias("total"))
    spread = cells.agg(F.sum(F.col("n") * v.squared_norm(centre)).alias("between"))
    return energy.crossJoin(spread).select((F.col("energy") - F.col("between") / F.col("total")).alias("variance"))


def moment_objective(n: DataFrame, weight: float) -> DataFrame:
    """V, norm of the residual cross moment M, and J = V + weight |M|, for nodes with x, q and cell."""
    cells = representatives(n)
    norm = residual_moment(n, cells).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("m_norm"))
    return within_variance(n, cells, "x", "c").crossJoin(norm).select(F.col("variance").alias("v"), "m_norm", (F.col("variance") + weight * F.col("m_norm")).alias("j"))


def label_divergence(n: DataFrame) -> DataFrame:
    """Mean Kullback-Leibler divergence of q from its cell's mean label."""
    cells = means(n, "q", "s")
    kl = v.total(F.zip_with("q", "s", lambda q, s: v.xlogy(q, q) - v.xlogy(q, s)))
    return n.join(F.broadcast(cells), "cell").agg(F.avg(kl).alias("kl"))


def soft_moments(n: DataFrame) -> DataFrame:
    """(cell, dim, s): sum_i p_ij a_i / N for nodes with p (one probability a cell) and material a."""
    size = n.agg(F.count("*").alias("total"))
    rows = n.select(F.posexplode("p").alias("cell", "w"), "a").select("cell", "w", F.posexplode("a").alias("dim", "v"))
    return rows.groupBy("cell", "dim").agg(F.sum(F.col("w") * F.col("v")).alias("s")).crossJoin(F.broadcast(size)).select("cell", "dim", (F.col("s") / F.col("total")).alias("s"))


def sparse_moments(n: DataFrame) -> DataFrame:
    """The same for nodes with cand (cells), p (their probabilities) and a."""
    size = n.agg(F.count("*").alias("total"))
    rows = n.select(F.explode(F.arrays_zip("cand", "p")).alias("e"), "a").select(F.col("e.cand").alias("cell"), F.col("e.p").alias("w"), F.posexplode("a").alias("dim", "v"))
    return rows.groupBy("cell", "dim").agg(F.sum(F.col("w") * F.col("v")).alias("s")).crossJoin(F.broadcast(size)).select("cell", "dim", (F.col("s") / F.col("total")).alias("s"))


def mass_diagnostics(cells: DataFrame) -> DataFrame:
    """Smallest and largest mass and the effective number of cells, from (cell, n)."""
    size = cells.agg(F.sum("n").alias("total"))
    mass = cells.crossJoin(F.broadcast(size)).select((F.col("n") / F.col("total")).alias("m"))
    return mass.agg(F.min("m").alias("min_mass"), F.max("m").alias("max_mass"), (1 / F.sum(F.col("m") * F.col("m"))).alias("effective_cells"))


def node_weights(logits: DataFrame) -> DataFrame:
    """(id, w): softmax of logit over all nodes, times their number."""
    top = logits.agg(F.max("logit").alias("top"))
    shifted = logits.crossJoin(F.broadcast(top)).select("id", F.exp(F.col("logit") - F.col("top")).alias("e"))
    every = shifted.agg(F.sum("e").alias("t"), F.count("*").alias("n"))
    return shifted.crossJoin(F.broadcast(every)).select("id", (F.col("e") / F.col("t") * F.col("n")).alias("w"))


def split_metrics(n: DataFrame) -> DataFrame:
    """(split, accuracy in percent, nll, teacher_ce) for nodes with logits, y and q."""
    logp = F.transform("logits", lambda x: x - v.log_sum_exp("logits"))
    rows = n.withColumn("logp", logp).withColumn("guess", F.array_position("logits", F.array_max("logits")) - 1)
    return rows.groupBy("split").agg(
        (100 * F.avg((F.col("guess") == F.col("y")).cast("double"))).alias("accuracy"),
        (-F.avg(F.element_at("logp", F.col("y") + 1))).alias("nll"),
        (-F.avg(v.dot("q", "logp"))).alias("teacher_ce"),
    )


def split_gaps(metrics: DataFrame) -> DataFrame:
    """One row: accuracy and nll of each split as columns, val nll less train's and train accuracy less val's."""
    def of(split: str, c: str) -> F.Column:
        return F.max(F.when(F.col("split") == split, F.col(c)))

    wide = metrics.agg(*[of(s, c).alias(f"{s}_{c}") for s in ("train", "val", "test") for c in ("accuracy", "nll")], of("train", "teacher_ce").alias("train_teacher_ce"))
    return wide.withColumn("val_minus_train_nll", F.col("val_nll") - F.col("train_nll")).withColumn("train_minus_val_accuracy", F.col("train_accuracy") - F.col("val_accuracy"))


def inductive_metrics(n: DataFrame, labelled_graph: str = "train") -> DataFrame:
    """(graph_id, accuracy, nll, teacher_ce): teacher labels exist on one graph only and are null elsewhere."""
    rows = split_metrics(n.withColumnRenamed("graph_id", "split") if "split" not in n.columns else n.drop("split").withColumnRenamed("graph_id", "split"))
    return rows.select(F.col("split").alias("graph_id"), "accuracy", "nll", F.when(F.col("split") == labelled_graph, F.col("teacher_ce")).alias("teacher_ce"))


def smooth_objective(n: DataFrame, weight: float, epsilon: float) -> DataFrame:
    """V + weight (sqrt(|M|^2 + eps^2) - eps)."""
    return moment_objective(n, weight).select("v", (F.col("v") + weight * (F.sqrt(F.col("m_norm") * F.col("m_norm") + epsilon * epsilon) - epsilon)).alias("j"))


def mass_variation(n: DataFrame) -> DataFrame:
    """Half the summed absolute difference of hard cell shares (cell) and soft cell masses (p)."""
    size = n.agg(F.count("*").alias("total"))
    soft = n.select(F.posexplode("p").alias("cell", "w")).groupBy("cell").agg(F.sum("w").alias("soft"))
    hard = n.groupBy("cell").agg(F.count("*").alias("hard"))
    return soft.join(hard, "cell", "full").crossJoin(F.broadcast(size)).agg((F.sum(F.abs(F.coalesce("soft", F.lit(0.0)) - F.coalesce("hard", F.lit(0))) / F.col("total")) / 2).alias("variation"))


def weighted_moments(n: DataFrame) -> DataFrame:
    """soft_moments with node weights w: sum_i w_i p_ij a_i / N."""
    return soft_moments(n.withColumn("a", v.scaled("a", F.col("w"))))


def weight_entropy(weights: DataFrame) -> DataFrame:
    """Mean of w ln w over the nodes."""
    return weights.agg(F.avg(v.xlogy(F.col("w"), F.col("w"))).alias("entropy"))


def outer_value(n: DataFrame, theta: DataFrame) -> DataFrame:
    """Mean cross-entropy of the soft labels under the head theta(cell, c), as head_gradient's objective."""
    from .assign import packed

    rows = n.crossJoin(F.broadcast(packed(theta, "c"))).withColumn("z", F.concat("x", F.array(F.lit(1.0))))
    rows = rows.withColumn("logits", F.transform("cells", lambda t: v.dot(F.col("z"), t["c"]))).withColumn("lse", v.log_sum_exp("logits"))
    return rows.agg(F.avg(F.col("lse") * v.total("q") - v.dot("q", "logits")).alias("ce"))


def head_gradient(n: DataFrame, theta: DataFrame) -> DataFrame:
    """(c, dim, g): mean over nodes of (softmax(theta z) - q)_c z_dim with z = [x, 1]; theta(cell, c) holds a row a class."""
    from .assign import packed

    rows = n.crossJoin(F.broadcast(packed(theta, "c"))).withColumn("z", F.concat("x", F.array(F.lit(1.0))))
    p = v.softmax(F.transform("cells", lambda t: v.dot(F.col("z"), t["c"])))
    rows = rows.select(F.posexplode(F.zip_with(p, "q", lambda a, b: a - b)).alias("c", "err"), "z").select("c", "err", F.posexplode("z").alias("dim", "v"))
    return rows.groupBy("c", "dim").agg(F.avg(F.col("err") * F.col("v")).alias("g"))
