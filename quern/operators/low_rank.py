"""Soft partition by logits of low rank: a factor row for each node, one for each cell, descended by Adam.

The nodes' factors and their two running moments stay in the nodes' rows; the cells' are small and live on the driver.
A step is two scans: one adds up the cells' statistics, the other gives every node its gradient, moves its factor, writes the
row and adds up the gradient of the cells' factors beside it.  The N x m matrix of logits exists only block by block.

A base may be added to the logits: a bias on a node's own cell (column cell), or left . right with a vector for each node
(column left) and one for each cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import discard, stored
from ..functions.sums import add_up, lists, matrix, merged, rows_of, sums
from .balanced import softmax
from .factors import gaussian
from .soft import objective_and_gradient

BETA1, BETA2, EPS = 0.9, 0.999, 1e-8
BLOCK = 4096


@dataclass(frozen=True)
class Base:
    """kind none, hard (bias on the cell of column cell) or factors (column left times right)."""

    kind: str = "none"
    bias: float = 0.0
    right: np.ndarray | None = None

    @property
    def column(self) -> list[str]:
        return {"none": [], "hard": ["cell"], "factors": ["left"]}[self.kind]

    def logits(self, batch: pa.RecordBatch, u: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = u @ cells.T / math.sqrt(u.shape[1])
        if self.kind == "hard":
            out[np.arange(len(u)), batch.column("cell").to_numpy()] += self.bias
        elif self.kind == "factors":
            out += matrix(batch.column("left")) @ self.right.T
        return out


def hard_base(cells: int, mixing: float) -> Base:
    """The bias that leaves ``mixing`` of a node's mass spread over all cells."""
    return Base("hard", math.log((1 - mixing + mixing / cells) / (mixing / cells)))


def _material(batch: pa.RecordBatch) -> np.ndarray:
    x, q = matrix(batch.column("x")), matrix(batch.column("q"))
    return np.concatenate((np.ones((len(x), 1)), x, q), 1)


def low_rank_moments(n: DataFrame, cells: np.ndarray, base: Base = Base()) -> np.ndarray:
    """cells x (1 + d + C): mean of p_j [1, x, q] for nodes (x, q, u and the base's column)."""

    def kernel(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            a = _material(b)
            yield "s", np.append((softmax(base.logits(b, matrix(b.column("u")), cells)).T @ a).ravel(), len(a))

    found = sums(n.select("x", "q", "u", *base.column), kernel)["s"]
    return found[:-1].reshape(len(cells), -1) / found[-1]


def _slopes(batch: pa.RecordBatch, cells: np.ndarray, base: Base, slope: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors of a block and the derivative by its logits."""
    u = matrix(batch.column("u"))
    p, d = softmax(base.logits(batch, u, cells)), _material(batch) @ slope.T / size
    return u, p * (d - (p * d).sum(1, keepdims=True)) / math.sqrt(u.shape[1])


def node_gradient(n: DataFrame, cells: np.ndarray, slope: np.ndarray, size: int, base: Base = Base()) -> DataFrame:
    """(id, g): derivative by each node's factor of a function of the moments whose derivative by them is slope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, block = _slopes(batch, cells, base, slope, size)
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(block @ cells)], ["id", "g"])

    return n.select("id", "x", "q", "u", *base.column).mapInArrow(run, "id long, g array<double>")


def _stepped(cells: np.ndarray, base: Base, slope: np.ndarray, size: int, step: int, rate: float):
    names = ["id", "x", "q", *base.column, "u", "m1", "m2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        schema = None
        for whole in batches:
            schema = whole.select(names).schema
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                u, block = _slopes(b, cells, base, slope, size)
                add_up(total, [("v", (block.T @ u).ravel())])
                g = block @ cells
                m1 = BETA1 * matrix(b.column("m1")) + (1 - BETA1) * g
                m2 = BETA2 * matrix(b.column("m2")) + (1 - BETA2) * g * g
                u = u - rate * (m1 / (1 - BETA1**step)) / (np.sqrt(m2 / (1 - BETA2**step)) + EPS)
                none = pa.nulls(len(u))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-3]), lists(u), lists(m1), lists(m2), none.cast(pa.string()), none.cast(pa.binary())], [*names, "key", "value"])
        if schema is not None:
            keys, values = rows_of(total)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(keys), f.type) for f in schema), keys, values], [*names, "key", "value"])

    return run


@dataclass
class LowRank:
    """The best step's statistics (mass, centres, labels), all objectives, and the factors after the last step."""

    mass: np.ndarray
    centres: np.ndarray
    labels: np.ndarray
    history: list[float]
    best_step: int
    nodes: DataFrame
    cells: np.ndarray


def random_factors(n: DataFrame, cells: int, rank: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """nodes with u, and V: standard normal numbers that are hashes of (seed, id, column), the same in every partitioning."""

    def draw(who: str | F.Column):
        return F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda j: gaussian(F.lit(seed), who, j))

    spark = n.sparkSession
    v = spark.range(cells).select("id", draw(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("v")).orderBy("id").collect()
    return n.withColumn("u", draw("id")), np.array([r.v for r in v])


def low_rank_partition(n: DataFrame, cells: np.ndarray, weight: float, steps: int = 100, rate: float = 0.01, base: Base = Base(), epsilon: float = 1e-12) -> LowRank:
    """Adam on V + weight |M| (smoothed at 0) from nodes (id, x, q, u and the base's column) and the cells' factors.

    The result's statistics are those of the step with the least objective, so never worse than the start.  Raises
    FloatingPointError if a mass vanishes or the objective is not finite; other columns of n are left out.
    """
    if not math.isfinite(weight) or weight <= 0 or steps < 0 or not rate > 0:
        raise ValueError("weight and rate must be positive, steps not negative")
    zero = F.transform("u", lambda _: F.lit(0.0))
    table = stored(n.select("id", "x", "q", *base.column, F.col("u"), zero.alias("m1"), zero.alias("m2")), "low-rank")
    d = table.select(F.size("x").alias("d")).first().d

    def crossed(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        x, q = matrix(batch.column("x")), matrix(batch.column("q"))
        yield "c", np.concatenate(([len(x), (x * x).sum()], (x.T @ q).ravel()))

    found = sums(table.select("x", "q"), crossed)["c"]
    size, energy, cross = int(found[0]), found[1] / found[0], (found[2:] / found[0]).reshape(d, -1)
    cells = cells.copy()
    m1, m2 = np.zeros_like(cells), np.zeros_like(cells)
    history, best, best_step = [], None, 0
    for step in range(steps + 1):
        s = low_rank_moments(table, cells, base)
        if not np.isfinite(s).all() or (s[:, 0] <= 0).any():
            raise FloatingPointError(f"invalid statistics at step {step}")
        j, slope = objective_and_gradient(s, energy, cross, weight, epsilon)
        history.append(j)
        if best is None or j < min(history[:-1]):
            best, best_step = s, step
        if step == steps:
            break
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
        wide = stored(table.mapInArrow(_stepped(cells, base, slope, size, step + 1, rate), shape + ", key string, value binary"), "low-rank")
        g = merged(wide.where("key is not null"))["v"].reshape(cells.shape)
        m1, m2 = BETA1 * m1 + (1 - BETA1) * g, BETA2 * m2 + (1 - BETA2) * g * g
        cells = cells - rate * (m1 / (1 - BETA1 ** (step + 1))) / (np.sqrt(m2 / (1 - BETA2 ** (step + 1))) + EPS)
        discard(table)
        table = wide.where("id is not null").drop("key", "value")
    mass = best[:, 0]
    return LowRank(mass * size, best[:, 1 : 1 + d] / mass[:, None], best[:, 1 + d :] / mass[:, None], history, best_step, table, cells)
