"""Soft assignment by gradient descent: each step is one aggregation of moments and one projection of the logits.

The gradient of any objective of the moments S = mean of p_j a, a = [1, x, q], with respect to a node's logits is
p (D - sum p D) with D_j = a . (dJ/dS_j) / N, so a step broadcasts one vector a cell and shuffles no node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.stages import cut
from . import moments
from .factors import rows_of


def objective_and_gradient(s: np.ndarray, energy: float, cross: np.ndarray, weight: float, epsilon: float = 1e-12) -> tuple[float, np.ndarray]:
    """V + weight (sqrt(|M|^2 + eps^2) - eps) and its derivative by the moments."""
    d = cross.shape[0]
    mass, x, q = s[:, 0], s[:, 1 : 1 + d], s[:, 1 + d :]
    m = cross - (x / mass[:, None]).T @ q
    norm = np.sqrt((m**2).sum() + epsilon**2)
    g = m / norm
    gradient = np.empty_like(s)
    gradient[:, 0] = ((x**2).sum(1) + weight * ((x @ g) * q).sum(1)) / mass**2
    gradient[:, 1 : 1 + d] = -(2 * x + weight * q @ g.T) / mass[:, None]
    gradient[:, 1 + d :] = -weight * x @ g / mass[:, None]
    return float(energy - ((x**2).sum(1) / mass).sum() + weight * (norm - epsilon)), gradient


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _slopes(batch: pa.RecordBatch, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Material, logits and the derivative of the objective by the logits, of a batch of nodes."""
    x, q, logits = (rows_of(batch.column(c)) for c in ("x", "q", "logits"))
    a = np.hstack([np.ones((len(x), 1)), x, q])
    p, d = _softmax(logits), a @ gradient.T
    return a, logits, p * (d - (p * d).sum(1, keepdims=True))


def largest_slope(n: DataFrame, gradient: np.ndarray) -> float:
    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(_slopes(batch, gradient)[2]).max())])], ["m"])

    return n.mapInArrow(most, "m double").agg(F.max("m")).first()[0]


def stepped(n: DataFrame, gradient: np.ndarray, scale: float) -> DataFrame:
    """nodes (id, x, q, logits) after one gradient step."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, logits, slope = _slopes(batch, gradient)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(logits) + 1) * logits.shape[1], pa.int32()), pa.array((logits - scale * slope).ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "x", "q")), lists], ["id", "x", "q", "logits"])

    return n.mapInArrow(move, "id long, x array<double>, q array<double>, logits array<double>")


def moved_moments(n: DataFrame, size: int, shape: tuple[int, int], gradient: np.ndarray | None = None, scale: float = 0.0) -> np.ndarray:
    """Moments of softmax(logits) after a step, without storing the step: one block product a batch, summed in Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                a, logits, slope = _slopes(batch, np.zeros(shape) if gradient is None else gradient)
                total += _softmax(logits - scale * slope).T @ a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["slot", "s"])

    rows = n.mapInArrow(sums, "slot long, s double").groupBy("slot").agg(F.sum("s").alias("s")).toPandas().sort_values("slot")
    return rows["s"].to_numpy().reshape(shape) / size


def descend(n: DataFrame, weight: float, steps: int = 20, rate: float = 1.0) -> tuple[DataFrame, list[float]]:
    """nodes (id, x, q, logits) after gradient steps on V + weight |M|; a step that raises J is halved and retried.

    ``rate`` is the largest change of a logit in the first step.  A trial is one pass that sums moments; an accepted step is
    written to the checkpoint folder.
    """
    n = cut(n.select("id", "x", "q", "logits"))
    first, size = n.first(), n.count()
    shape = (len(first.logits), 1 + len(first.x) + len(first.q))
    energy = n.agg(F.avg(v.squared_norm("x"))).first()[0]
    table = moments.cross_moment(n).toPandas()
    cross = np.zeros((len(first.x), len(first.q)))
    cross[table["i"], table["c"]] = table["m"]
    j, gradient = objective_and_gradient(moved_moments(n, size, shape), energy, cross, weight)
    history = [j]
    scale = rate / max(1e-30, largest_slope(n, gradient / size)) if steps else 0.0
    for _ in range(steps):
        for _ in range(6):
            j, fresh = objective_and_gradient(moved_moments(n, size, shape, gradient / size, scale), energy, cross, weight)
            if j <= history[-1]:
                break
            scale /= 2
        else:
            break
        n, gradient = cut(stepped(n, gradient / size, scale)), fresh
        history.append(j)
    return n, history
