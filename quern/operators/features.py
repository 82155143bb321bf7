"""Feature and label transforms: one aggregate for the statistics, one projection to apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v


def mean_vector(n: DataFrame, vector: str = "x") -> DataFrame:
    """One row: the mean of each component, in order."""
    per = n.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"]).alias("mean"))


def centred(n: DataFrame, vector: str = "x", of: DataFrame | None = None) -> DataFrame:
    mean = mean_vector(n if of is None else of, vector)
    return n.crossJoin(F.broadcast(mean)).withColumn(vector, v.minus(vector, "mean")).drop("mean")


def rms_features(n: DataFrame, of: DataFrame | None = None, eps: float = 1e-12) -> DataFrame:
    """x centred and divided by the root of the mean squared norm; statistics from ``of`` (all nodes if None)."""
    moved = centred(n, of=of)
    base = moved if of is None else centred(of)
    scale = base.agg(F.sqrt(F.avg(v.squared_norm("x"))).alias("rms"))
    return moved.crossJoin(F.broadcast(scale)).withColumn("x", v.scaled("x", 1 / F.greatest("rms", F.lit(eps)))).drop("rms")


def fitted_rms(n: DataFrame, eps: float = 1e-12) -> DataFrame:
    """One row (mean, rms) that can be stored and applied to other nodes."""
    scale = centred(n).agg(F.greatest(F.sqrt(F.avg(v.squared_norm("x"))), F.lit(eps)).alias("rms"))
    return mean_vector(n).crossJoin(scale)


def apply_rms(n: DataFrame, fitted: DataFrame) -> DataFrame:
    return n.crossJoin(F.broadcast(fitted)).withColumn("x", F.zip_with("x", "mean", lambda a, m: (a - m) / F.col("rms"))).drop("mean", "rms")


def undo_rms(n: DataFrame, fitted: DataFrame, vector: str = "x") -> DataFrame:
    """Vectors back in the units they had before apply_rms, as representatives are handed out."""
    return n.crossJoin(F.broadcast(fitted)).withColumn(vector, F.zip_with(vector, "mean", lambda a, m: a * F.col("rms") + m)).drop("mean", "rms")


def unit_sum(n: DataFrame) -> DataFrame:
    """Rows divided by the sum of absolute values; rows of zeros stay."""
    total = v.total(F.transform("x", F.abs))
    return n.withColumn("x", v.scaled("x", 1 / F.when(total > 0, total).otherwise(1.0)))


def unit_features(n: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Rows divided by their norm after centring."""
    return centred(n).withColumn("x", v.scaled("x", 1 / F.greatest(F.sqrt(v.squared_norm("x")), F.lit(eps))))


def train_zscore(n: DataFrame) -> DataFrame:
    """Each component centred and divided by its population deviation over training rows; deviation 0 counts as 1."""
    per = n.where("split = 'train'").select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = per.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("stats"))
    z = F.zip_with("x", "stats", lambda x, s: (x - s["m"]) / F.when(s["s"] == 0, 1.0).otherwise(s["s"]))
    return n.crossJoin(F.broadcast(stats)).withColumn("x", z).drop("stats")


def _energy(n: DataFrame) -> DataFrame:
    """Mean squared norm of the centred x and q."""
    return centred(centred(n), "q").agg(F.avg(v.squared_norm("x")).alias("gx"), F.avg(v.squared_norm("q")).alias("gq"))


def joint_embedding(n: DataFrame, alpha: float) -> DataFrame:
    """[sqrt(1/gx) (x - mean), sqrt(alpha/gq) (q - mean)]; a constant block gets weight 0."""
    moved = centred(centred(n), "q").crossJoin(F.broadcast(_energy(n)))
    wx = F.when(F.col("gx") > 0, F.sqrt(1 / F.col("gx"))).otherwise(0.0)
    wq = F.when(F.col("gq") > 0, F.sqrt(F.lit(alpha) / F.col("gq"))).otherwise(0.0)
    return moved.withColumn("e", F.concat(v.scaled("x", wx), v.scaled("q", wq))).drop("gx", "gq")


def bound_embedding(n: DataFrame, weight: float) -> DataFrame:
    """[sqrt(a) x, sqrt(b) q] centred, with a = 1 + weight eta / 2, b = weight / (2 eta), eta = sqrt(gq / gx)."""
    moved = centred(centred(n), "q").crossJoin(F.broadcast(_energy(n)))
    flat = (F.col("gx") <= 0) | (F.col("gq") <= 0)
    eta = F.sqrt(F.col("gq") / F.col("gx"))
    a = F.when(flat, 1.0).otherwise(1 + weight * eta / 2)
    b = F.when(flat, F.lit(float(weight > 0))).otherwise(weight / (2 * eta))
    return moved.withColumn("e", F.concat(v.scaled("x", F.sqrt(a)), v.scaled("q", F.sqrt(b)))).drop("gx", "gq")


def kernel_values(n: DataFrame, anchors: DataFrame, kind: str = "rbf") -> DataFrame:
    """(id, k): kernel of x with every anchor in id order, the bandwidth from the anchors; kinds rbf, linear, erf, relu, relu2, ...

    Anchors are few by contract; a block of rows meets all of them in one product.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.sums import lists, matrix

    own = np.array([r.x for r in anchors.select("id", "x").orderBy("id").collect()], float)
    norm = (own**2).sum(1)
    bw = norm.mean() if len(own) else 1.0

    def clamp(c):
        return np.clip(c, -1.0 + 1e-12, 1.0 - 1e-12)

    def values(x: np.ndarray) -> np.ndarray:
        if kind == "linear":
            return x @ own.T
        if kind == "rbf":
            return np.exp(-np.stack([((x - a) ** 2).sum(1) for a in own], 1) / bw)
        p, q, s = ((x**2).sum(1) / bw)[:, None], norm / bw, x @ own.T / bw
        if kind == "erf":
            return 2 / np.pi * np.arcsin(clamp(2 * s / np.sqrt((1 + 2 * p) * (1 + 2 * q))))
        scale = np.sqrt(p * q)
        # a zero vector has no angle: null as before
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = clamp(s / scale)
        for _ in range(int(kind[4:] or 1)):
            theta = np.arccos(clamp(cosine))
            cosine = (np.sin(theta) + (np.pi - theta) * np.cos(theta)) / np.pi
        return scale * cosine

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([some.column("id"), lists(values(matrix(some.column("x"))))], ["id", "k"])

    return n.select("id", "x").mapInArrow(run, "id long, k array<double>")


def class_mean_logits(n: DataFrame) -> DataFrame:
    """nodes with logits: minus the distance to the mean of each class over training rows, classes in order."""
    per = n.where("split = 'train'").select("y", F.posexplode("x").alias("dim", "v")).groupBy("y", "dim").agg(F.avg("v").alias("m"))
    means = per.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"]).alias("c"))
    side = means.agg(F.array_sort(F.collect_list(F.struct("y", "c"))).alias("classes"))
    logits = F.transform("classes", lambda c: -v.squared_distance(F.col("x"), c["c"]))
    return n.crossJoin(F.broadcast(side)).withColumn("logits", logits).drop("classes")


def soft_labels(n: DataFrame, temperature: float = 1.0) -> DataFrame:
    return n.withColumn("q", v.softmax("logits", temperature))


def adaptive_temperature(distances: DataFrame, base: float, eta: float) -> DataFrame:
    """(id, position, t) from (id, split, d): t = base (1 + eta position), position = d / (d + lower median of the
    positive distances of nodes outside training), 0 for training nodes."""
    outside = distances.where("split <> 'train' and d > 0").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("scale"))
    position = F.when(F.col("split") == "train", 0.0).otherwise(F.col("d") / (F.col("d") + F.coalesce("scale", F.lit(1.0))))
    placed = distances.crossJoin(F.broadcast(outside)).withColumn("position", position)
    return placed.select("id", "position", (base * (1 + eta * F.col("position"))).alias("t"))


def covariance(n: DataFrame):
    """The d x d matrix of mean products of the components of x: one block product a batch, summed in Spark."""
    import numpy as np
    import pyarrow as pa

    def blocks(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                g = (x.T @ x).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g))), pa.array(g)], ["slot", "g"])

    total = n.count()
    sums = n.select("x").mapInArrow(blocks, "slot long, g double").groupBy("slot").agg(F.sum("g").alias("g")).toPandas().sort_values("slot")
    d = round(len(sums) ** 0.5)
    return sums["g"].to_numpy().reshape(d, d) / total


def whitened(n: DataFrame, power: float = 0.5, ridge: float = 0.01) -> DataFrame:
    """Fractional whitening: the covariance is summed in Spark, its d eigenvectors are found on the driver."""
    import numpy as np

    moved = centred(n)
    values, basis = np.linalg.eigh(covariance(moved))
    values = np.maximum(values, 0)
    w = basis @ np.diag((values + ridge * values.max()) ** (-power / 2)) @ basis.T
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in w])
    return rms_features(moved.withColumn("x", F.transform(rows, lambda r: v.dot(F.col("x"), r))))
