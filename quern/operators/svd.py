"""Singular vectors of tall matrices without their Gram matrix, whose condition number is the square of theirs.

A task reduces its rows to the triangular factor of a QR decomposition; stacked factors are reduced again, first as the shuffle
deals them and then to one.  What is left has the singular values and right vectors of the whole matrix.  Wide matrices
are first projected on a subspace that a few passes find (a block power iteration with QR between the products).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sums import matrix, sums
from . import seeding
from .factors import linear, mapped

OVERSAMPLING, ITERATIONS = 8, 4


def _reduced(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.concatenate((r, rows)), mode="r")


def _packed(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["wide", "r"])


def _of_rows(vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                r = _reduced(r, matrix(batch.column(vector)).astype(float))
        yield from _packed(r)

    return run


def _of_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    r = None
    for batch in batches:
        for wide, part in zip(batch.column("wide").to_pylist(), batch.column("r"), strict=True):
            r = _reduced(r, np.frombuffer(part.as_buffer()).reshape(-1, wide))
    yield from _packed(r)


def triangular(n: DataFrame, vector: str = "x") -> np.ndarray:
    """R with R'R = X'X for the rows X of the vectors, by a tree of QR decompositions."""
    shape = "wide int, r binary"
    spread = int(n.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = n.select(vector).mapInArrow(_of_rows(vector), shape).repartition(spread).mapInArrow(_of_factors, shape)
    rows = parts.coalesce(1).mapInArrow(_of_factors, shape).collect()  # one triangle of the size of the dimensions
    if not rows:
        raise ValueError("no rows")
    return np.frombuffer(bytes(rows[0].r)).reshape(-1, rows[0].wide)


def right_vectors(n: DataFrame, rank: int, vector: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values and their right vectors as columns, the entry of largest size of each positive."""
    _, s, vt = np.linalg.svd(triangular(n, vector), full_matrices=False)
    axes = vt[:rank].T
    flip = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return s[:rank], axes * np.where(flip == 0, 1, flip)


def range_finder(n: DataFrame, rank: int, vector: str = "x", oversampling: int = OVERSAMPLING, iterations: int = ITERATIONS, seed: int = 0) -> np.ndarray:
    """An orthonormal basis (dims x (rank + oversampling) at most) near the leading right vectors: a product with X'X a pass."""
    d = n.select(F.size(vector).alias("d")).first().d
    k = min(rank + oversampling, d)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k)))
    for _ in range(iterations + 1):

        def kernel(batch: pa.RecordBatch, basis: np.ndarray = basis) -> Iterator[tuple[str, np.ndarray]]:
            x = matrix(batch.column(vector)).astype(float)
            yield "b", (x.T @ (x @ basis)).ravel()

        basis, _ = np.linalg.qr(sums(n.select(vector), kernel)["b"].reshape(d, k))
    return basis


def leading_axes(n: DataFrame, rank: int, vector: str = "x", **options) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a wide matrix by range_finder: exact on the subspace it finds."""
    basis = range_finder(n, rank, vector, **options)
    inside = mapped(n, linear(basis), vector, "inside")
    s, axes = right_vectors(inside, rank, "inside")
    axes = basis @ axes
    flip = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return s, axes * np.where(flip == 0, 1, flip)


def svd_factors(n: DataFrame, rank: int, vector: str = "logits", right: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, u) and V with u V' / sqrt(rank) the best form of that rank of the vectors, or of vectors times right'.

    Singular values are shared evenly; beyond the matrix's own rank the factors are padded with zeros.
    """
    r = triangular(n, vector)
    small = r if right is None else r @ right.T
    _, s, vt = np.linalg.svd(small, full_matrices=False)
    top = s.max(initial=0.0)
    k = min(rank, int((s > 1e-12 * max(top, 1e-300)).sum())) if top > 0 else 0
    share = rank**0.25
    cells = np.zeros((vt.shape[1], rank))
    cells[:, :k] = vt[:k].T * np.sqrt(s[:k]) * share
    # u = X right' v / s * sqrt(s)
    onto = np.zeros((r.shape[1], rank))
    onto[:, :k] = (np.eye(r.shape[1]) if right is None else right.T) @ vt[:k].T / np.sqrt(s[:k]) * share
    return mapped(n, linear(onto), vector, "u"), cells


def distance_factors(n: DataFrame, cells: int, rank: int, seed: int = 0, temperature: float = 1.0, most_sweeps: int = 20) -> tuple[DataFrame, np.ndarray]:
    """(id, u) and V whose product stands for minus squared distances to k-means centres in the leading rank - 1 axes.

    x is projected on its axes; centres start by spread_centres and take Lloyd steps; costs are centred over the cells and
    scaled to a root mean square of 1 / temperature before they are factorised.
    """
    if rank < 2:
        raise ValueError("rank must be at least 2")
    d = n.select(F.size("x").alias("d")).first().d
    k = min(rank - 1, d)
    axes = leading_axes(n, k)[1] if d > 4 * (k + OVERSAMPLING) else right_vectors(n, k)[1]
    rows = mapped(n, linear(axes), "x", "x")
    centres = seeding.spread_centres(rows, cells, [seed])[0]
    for _ in range(most_sweeps):

        def kernel(batch: pa.RecordBatch, centres: np.ndarray = centres) -> Iterator[tuple[str, np.ndarray]]:
            x = matrix(batch.column("x"))
            near = seeding.squared_distances(x, centres).argmin(1)
            total = np.zeros((cells, x.shape[1] + 1))
            np.add.at(total, near, np.concatenate((np.ones((len(x), 1)), x), 1))
            yield "t", total.ravel()

        total = sums(rows.select("x"), kernel)["t"].reshape(cells, -1)
        fresh = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), centres)
        if np.array_equal(fresh, centres):
            break
        centres = fresh
    left = mapped(rows, lambda x: np.concatenate((2 * x, np.ones((len(x), 1))), 1), "x", "left")
    right = np.concatenate((centres, -(centres**2).sum(1, keepdims=True)), 1)
    right = right - right.mean(0)
    r = triangular(left, "left")
    rms = max(1e-12, float(np.linalg.norm(r @ right.T)) / np.sqrt(n.count() * cells))
    return svd_factors(left, rank, "left", right / (temperature * rms))
