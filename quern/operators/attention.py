"""Assignment logits of nodes to centres in factorised forms; the cell side is small, the N x m matrix exists row by row.

With costs l = 2 x.c - |c|^2: metric adds the costs of both sides mapped by one matrix, low_rank adds u.v to them, svd_uv and
random_uv replace them by factors of a rank: the best ones, or random ones of the same column norms.  All are over tau.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sums import matrix, sums
from . import svd
from .factors import gaussian, linear, mapped


def _costs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return 2 * x @ c.T - (c**2).sum(1)


def _checked(rank: int, tau: float) -> None:
    if rank < 1 or not math.isfinite(tau) or tau <= 0:
        raise ValueError("rank and tau must be positive")


def metric_logits(n: DataFrame, centres: np.ndarray, weights: np.ndarray, tau: float) -> DataFrame:
    """(id, logits): costs plus the costs after mapping nodes and centres by weights (dims x rank)."""
    _checked(weights.shape[1], tau)
    other = centres @ weights
    return mapped(n, lambda x: (_costs(x, centres) + _costs(x @ weights, other)) / tau, name="logits")


def low_rank_logits(n: DataFrame, centres: np.ndarray, cells: np.ndarray, tau: float) -> DataFrame:
    """(id, logits): costs plus u.v over the root of the rank, for nodes with x and u."""
    _checked(cells.shape[1], tau)
    both = n.select("id", F.concat("x", "u").alias("xu"))
    d = centres.shape[1]
    return mapped(both, lambda a: (_costs(a[:, :d], centres) + a[:, d:] @ cells.T / math.sqrt(cells.shape[1])) / tau, "xu", "logits")


def uv_factors(n: DataFrame, centres: np.ndarray, rank: int, seed: int | None = None) -> tuple[DataFrame, np.ndarray, float]:
    """(id, u), V and the share of the costs' norm that the rank leaves out; with a seed, random factors of the same column norms,
    V centred over the cells."""
    right = np.concatenate((centres, -(centres**2).sum(1, keepdims=True)), 1)
    right = right - right.mean(0)
    if not 1 <= rank <= min(right.shape):
        raise ValueError("the rank exceeds the dimensions of the costs")
    left = mapped(n, lambda x: np.concatenate((2 * x, np.ones((len(x), 1))), 1), name="left")
    s = np.linalg.svd(svd.triangular(left, "left") @ right.T, compute_uv=False)
    lost = float(np.linalg.norm(s[rank:]) / max(1e-30, np.linalg.norm(s)))
    u, v = svd.svd_factors(left, rank, "left", right)
    if seed is None:
        return u, v, lost

    def squares(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return (matrix(batch.column(name)) ** 2).sum(0)

    def both(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        yield "u", squares(batch, "u")
        yield "r", squares(batch, "r")

    drawn = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda j: gaussian(F.lit(seed), "id", j))
    rows = u.withColumn("r", drawn)
    norms = sums(rows.select("u", "r"), both)
    mine = np.random.default_rng(seed).normal(size=v.shape)
    mine -= mine.mean(0)
    mine *= np.linalg.norm(v, axis=0) / np.maximum(np.linalg.norm(mine, axis=0), 1e-30)
    scale = np.sqrt(norms["u"] / np.maximum(norms["r"], 1e-60))
    return mapped(rows, linear(np.diag(scale)), "r", "u"), mine, lost


def uv_logits(u: DataFrame, cells: np.ndarray, tau: float) -> DataFrame:
    _checked(cells.shape[1], tau)
    return mapped(u, linear(cells.T / (math.sqrt(cells.shape[1]) * tau)), "u", "logits")


def random_anchors(n: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """x of the nodes with the smallest hashes of (seed, id)."""
    rows = n.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(cells).select("x").collect()
    if len(rows) < cells:
        raise ValueError("fewer nodes than cells")
    return np.array([r.x for r in rows])


def initial_encoder(inputs: int, outputs: int, hidden: int = 0, seed: int = 0) -> list[np.ndarray]:
    """Weights of an encoder: one normal matrix over the root of its rows, or with ``hidden`` two and a bias of 0 between."""
    rng = np.random.default_rng(seed)
    if not hidden:
        return [rng.normal(size=(inputs, outputs)) / math.sqrt(inputs)]
    return [rng.normal(size=(inputs, hidden)) * math.sqrt(2 / inputs), np.zeros(hidden), rng.normal(size=(hidden, outputs)) / math.sqrt(hidden)]


def prototypes(n: DataFrame, cells: int) -> np.ndarray:
    """The means of x in cells 0 to cells - 1 of nodes (x, cell); raises ValueError for a cell without nodes."""
    from .moments import means

    found = {r.cell: r.c for r in means(n, "x", "c").collect()}
    empty = [c for c in range(cells) if c not in found]
    if empty:
        raise ValueError(f"cells {empty} are empty")
    return np.array([found[c] for c in range(cells)])


def feature_rms(n: DataFrame, vector: str = "x") -> DataFrame:
    """One row: root of the mean square of all components, and the mean norm of a row."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return n.agg(F.sqrt(F.sum(square) / F.sum(F.size(vector))).alias("rms"), F.avg(F.sqrt(square)).alias("mean_norm"))
