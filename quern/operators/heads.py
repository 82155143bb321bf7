"""Linear heads and teachers fitted with Spark ML on weighted rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.stages import cut


def fit_head(cells: DataFrame, penalty: float) -> tuple[list[list[float]], DataFrame]:
    """Softmax head on representatives (cell, n, c, s), bias penalised like every weight.

    Spark ML leaves a constant column out, so [c, 1] is turned by a Householder reflection that mixes the bias into
    all columns, and the coefficients are turned back.  Rows are (cell, class) with weight mass x label.
    """
    d = len(cells.first().c) + 1
    w = [1.0 / d**0.5] * d
    w[-1] -= 1.0
    norm = sum(x * x for x in w)
    mirror = F.array(*[F.lit(x) for x in w])
    z = F.concat("c", F.array(F.lit(1.0)))
    turned = F.zip_with(z, mirror, lambda a, b: a - b * (2.0 / norm) * v.dot(z, mirror))
    total = cells.agg(F.sum("n").alias("total"))
    rows = cells.crossJoin(F.broadcast(total)).select(array_to_vector(turned).alias("features"), (F.col("n") / F.col("total")).alias("mass"), F.posexplode("s").alias("label", "share"))
    rows = rows.select("features", F.col("label").cast("double").alias("label"), (F.col("mass") * F.col("share")).alias("weight")).where("weight > 0")
    model = LogisticRegression(regParam=penalty, fitIntercept=False, standardization=False, family="multinomial", weightCol="weight", maxIter=500, tol=1e-10).fit(rows)
    theta = []
    for row in model.coefficientMatrix.toArray().tolist():
        along = sum(a * b for a, b in zip(row, w, strict=True)) * 2.0 / norm
        theta.append([a - b * along for a, b in zip(row, w, strict=True)])
    return theta, rows


def kernel_teacher(kernels: DataFrame, n: DataFrame, gamma: float) -> DataFrame:
    """nodes with logits of a multinomial model without bias on kernel features: mean loss + gamma/n |W|^2 over training rows."""
    # computed once: the fit, its count and the outputs all read it
    rows = cut(n.join(kernels, "id")).withColumn("features", array_to_vector("k")).withColumn("label", F.col("y").cast("double"))
    train = rows.where("split = 'train'")
    fitted = LogisticRegression(regParam=2 * gamma / train.count(), fitIntercept=False, standardization=False, family="multinomial", maxIter=200, tol=1e-10).fit(train)
    out = fitted.transform(rows)
    return out.select(*n.columns, vector_to_array("rawPrediction").alias("logits"))


def temperature_curve(n: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 61, split: str = "val") -> DataFrame:
    """(point, t, ce) of the labels of a split over a geometric grid of temperatures."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) * F.pow(F.lit(high / low), i / (points - 1)))
    rows = n.where(F.col("split") == split).select("logits", "y", F.posexplode(grid).alias("point", "t"))
    scaled = F.transform("logits", lambda x: x / F.col("t"))
    ce = v.log_sum_exp(scaled) - F.element_at(scaled, F.col("y") + 1)
    return rows.groupBy("point").agg(F.max("t").alias("top"), F.avg(ce).alias("ce")).withColumnRenamed("top", "t")


def calibrated_temperature(n: DataFrame, low: float = 0.05, high: float = 20.0, log_scale: bool = False, split: str = "val", points: int = 33, rounds: int = 8) -> tuple[DataFrame, str]:
    """One row (t, ce, ce_before) for the temperature of least cross-entropy on the labels of a split, and where it lies.

    The loss is convex in 1/T: each round evaluates a grid of 1/T (or of ln T) in one pass over the split and keeps the two
    intervals around its best point.  The ends and T = 1 are candidates too; the first of equals wins.
    """
    spark = n.sparkSession
    rows = n.where(F.col("split") == split).select("logits", "y")
    to_t = (lambda u: float(np.exp(u))) if log_scale else (lambda u: 1.0 / u)
    a, b = (float(np.log(low)), float(np.log(high))) if log_scale else (1 / high, 1 / low)

    def losses(places: list[float]) -> list[float]:
        grid = F.array(*[F.lit(to_t(u)) for u in places])
        scaled = F.transform("logits", lambda x: x / F.col("t"))
        ce = v.log_sum_exp(scaled) - F.element_at(scaled, F.col("y") + 1)
        found = rows.select("logits", "y", F.posexplode(grid).alias("i", "t")).groupBy("i").agg(F.avg(ce).alias("ce")).collect()
        return [r.ce for r in sorted(found, key=lambda r: r.i)]

    ends, lo, hi = [a, b], a, b
    for _ in range(rounds):
        places = np.linspace(lo, hi, points).tolist()
        best = int(np.argmin(losses(places)))
        lo, hi = places[max(0, best - 1)], places[min(points - 1, best + 1)]
    candidates = [*ends, (lo + hi) / 2, *([0.0 if log_scale else 1.0] if low <= 1 <= high else [])]
    ce = losses([*candidates, 0.0 if log_scale else 1.0])
    pick = int(np.argmin(np.round(ce[:-1], 12)))
    where = ["lower", "upper"][::1 if log_scale else -1][pick] if pick < 2 else "interior"
    return spark.createDataFrame([(to_t(candidates[pick]), ce[pick], ce[-1])], "t double, ce double, ce_before double"), where
