"""Assignments with equal cell masses: Sinkhorn steps to convergence, moments, and the gradient through the fixed point.

p_i = softmax(logits_i - dual), with duals such that every cell has the mean mass 1/m.  Duals, masses and moments are of the
size of the cells; every step is one scan that adds them up.  The derivative of the moments by the logits goes through
the duals, so it needs the solution of (diag(c) - P'P/N + 11'/m) z = r, either from the m x m matrix, summed in one scan, or
matrix-free by conjugate gradients with a scan for each product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.sums import lists, matrix, sums


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def masses(n: DataFrame, dual: np.ndarray) -> np.ndarray:
    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        p = softmax(matrix(batch.column("logits")) - dual)
        yield "m", np.append(p.sum(0), len(p))

    found = sums(n.select("logits"), kernel)
    if "m" not in found:
        raise ValueError("no nodes")
    return found["m"][:-1] / found["m"][-1]


def balanced_duals(n: DataFrame, cells: int, tolerance: float = 1e-8, most: int = 500, start: np.ndarray | None = None) -> tuple[np.ndarray, int, float]:
    """(duals with mean 0, scans, largest relative error of a cell's mass) for nodes with logits.

    Raises RuntimeError if a cell's mass is still off by more than tolerance after ``most`` scans, FloatingPointError if
    a mass is zero or not finite.
    """
    dual = np.zeros(cells) if start is None else start.copy()
    error = np.inf
    for scan in range(1, most + 1):
        mass = masses(n, dual)
        if not np.isfinite(mass).all() or (mass <= 0).any():
            raise FloatingPointError("a cell's mass is zero or not finite")
        error = float(np.abs(cells * mass - 1).max())
        if error <= tolerance:
            return dual, scan, error
        dual = dual + np.log(cells * mass)
        dual -= dual.mean()
    raise RuntimeError(f"masses did not become equal in {most} scans: largest relative error {error:.3g}")


def balanced_moments(n: DataFrame, dual: np.ndarray) -> np.ndarray:
    """cells x dims: mean of p_j a, for nodes with logits and a."""

    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        a = matrix(batch.column("a"))
        s = softmax(matrix(batch.column("logits")) - dual).T @ a
        yield "s", np.append(s.ravel(), len(a))

    found = sums(n.select("logits", "a"), kernel)["s"]
    return found[:-1].reshape(len(dual), -1) / found[-1]


def _direction(batch: pa.RecordBatch, dual: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, d = softmax(matrix(batch.column("logits")) - dual), matrix(batch.column("a")) @ slope.T
    return p, d


def correction(n: DataFrame, dual: np.ndarray, slope: np.ndarray, matrix_free: bool = False, rtol: float = 1e-9, most: int = 200) -> np.ndarray:
    """What the duals take off the direction of each cell.  Raises RuntimeError if the solution is not good enough."""
    m = len(dual)

    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        p, d = _direction(batch, dual, slope)
        yield "r", (p * (d - (p * d).sum(1, keepdims=True))).sum(0)
        yield "c", np.append(p.sum(0), len(p))
        yield "d", (p**2).sum(0)
        if not matrix_free:
            yield "g", (p.T @ p).ravel()

    found = sums(n.select("logits", "a"), kernel)
    size = found["c"][-1]
    mass, r = found["c"][:-1] / size, found["r"] / size
    r = r - r.mean()
    target = max(1e-14, rtol * float(np.linalg.norm(r)))
    if not matrix_free:
        system = np.diag(mass) - found["g"].reshape(m, m) / size + 1 / m
        z = np.linalg.solve(system, r)
        if not np.isfinite(z).all() or np.linalg.norm(system @ z - r) > max(target, 1e-7 * np.linalg.norm(r)):
            raise RuntimeError("the system of the duals could not be solved")
        return z

    def times(value: np.ndarray) -> np.ndarray:
        def product(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
            p = softmax(matrix(batch.column("logits")) - dual)
            yield "v", p.T @ (p @ value)

        return mass * value - sums(n.select("logits"), product)["v"] / size + value.mean()

    diagonal = mass - found["d"] / size + 1 / m
    z, left = np.zeros(m), r.copy()
    way = left / diagonal
    energy = left @ way
    for _ in range(most):
        if np.linalg.norm(left) <= target:
            return z
        image = times(way)
        step = energy / (way @ image)
        z, left = z + step * way, left - step * image
        fresh = left / diagonal
        energy, before = left @ fresh, energy
        way = fresh + energy / before * way
    raise RuntimeError("the system of the duals did not settle")


def balanced_gradient(n: DataFrame, dual: np.ndarray, slope: np.ndarray, matrix_free: bool = False) -> DataFrame:
    """(id, g): derivative by each node's logits of a function of the moments whose derivative by them is slope (cells x dims)."""
    z = correction(n, dual, slope, matrix_free)
    size = n.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, d = _direction(batch, dual, slope)
                d = d - z
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(p * (d - (p * d).sum(1, keepdims=True)) / size)], ["id", "g"])

    return n.select("id", "logits", "a").mapInArrow(run, "id long, g array<double>")
