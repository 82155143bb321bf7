"""Starting centres for many seeds in a fixed number of passes, whatever the number of cells.

Rounds of oversampling: each keeps every node with a probability in proportion to its squared distance from the centres
found so far, some cells / rounds times two of them in expectation.  The candidates, a few times as many as cells, are
weighted by the nodes nearest to them and thinned out by k-means++ with local trials, as they are few.  All random numbers
are hashes of (seed, round, id), so the result doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.stages import discard, stored
from ..functions.sums import add_up, lists, matrix, merged, rows_of, sums

ROUNDS, OVERSAMPLING, TRIALS = 5, 2.0, 4
BLOCK = 4096


def uniform(seed: int, step: int, ids: np.ndarray) -> np.ndarray:
    """Of (0, 1], for each id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + step * 7_919 + 1) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return ((h >> np.uint64(11)).astype(float) + 1) / float(1 << 53)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def _narrowed(fresh: list[np.ndarray]):
    """Distances to the nearest centre so far, after adding each seed's fresh centres; and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        names = ["id", "x", "gap", "key", "value"]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, gap = matrix(batch.column("x")), matrix(batch.column("gap")).copy()
                for s, c in enumerate(fresh):
                    if len(c):
                        gap[:, s] = np.minimum(gap[:, s], squared_distances(x, c).min(1))
                # what rounding leaves of a node that is a centre
                gap[gap <= 1e-12 * (1 + (x**2).sum(1))[:, None]] = 0
                add_up(total, [("gaps", gap.sum(0))])
                none = pa.nulls(len(x))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), lists(gap), none.cast(pa.string()), none.cast(pa.binary())], names)
        keys, values = rows_of(total)
        none = pa.nulls(len(keys))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.list_(pa.float64())), none.cast(pa.list_(pa.float64())), keys, values], names)

    return run


def _kept(seeds: Sequence[int], step: int, rate: np.ndarray):
    """Nodes drawn for each seed: (seed's place, id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, gap = batch.column("id").to_numpy(), matrix(batch.column("gap"))
                for s, seed in enumerate(seeds):
                    go = np.flatnonzero(uniform(seed, step, ids) < rate[s] * gap[:, s])
                    if len(go):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), s, np.int32)), batch.column("id").take(pa.array(go)), batch.column("x").take(pa.array(go))], ["s", "id", "x"])

    return run


def thinned(points: np.ndarray, weights: np.ndarray, cells: int, seed: int, trials: int = TRIALS) -> np.ndarray:
    """``cells`` of the weighted points by k-means++: of ``trials`` draws the one that leaves the least cost; then Lloyd steps."""
    u = uniform(seed, -1, np.arange(cells * trials + 1))
    picked = [int(np.searchsorted(np.cumsum(weights) / weights.sum(), u[-1]))]
    gap = squared_distances(points, points[picked])[:, 0]
    for k in range(1, cells):
        mass = weights * gap
        mass[picked] = 0
        if mass.sum() <= 0:
            picked.append(int(np.setdiff1d(np.arange(len(points)), picked)[0]))
        else:
            drawn = np.minimum(np.searchsorted(np.cumsum(mass) / mass.sum(), u[k * trials : (k + 1) * trials]), len(points) - 1)
            after = np.minimum(gap[:, None], squared_distances(points, points[drawn]))
            picked.append(int(drawn[np.argmin(weights @ after)]))
        gap = np.minimum(gap, squared_distances(points, points[picked[-1:]])[:, 0])
    centres = points[picked]
    for _ in range(20):
        near = squared_distances(points, centres).argmin(1)
        mass = np.bincount(near, weights, cells)
        moved = np.stack([np.bincount(near, weights * points[:, j], cells) for j in range(points.shape[1])], 1)
        fresh = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
        if np.allclose(fresh, centres, rtol=0, atol=1e-12):
            break
        centres = fresh
    return centres


def spread_centres(nodes: DataFrame, cells: int, seeds: Sequence[int] = (0,), rounds: int = ROUNDS, trials: int = TRIALS) -> list[np.ndarray]:
    """Centres (cells x dims) for each seed from nodes (id, x); 3 rounds + 2 scans for all seeds together.

    With fewer distinct nodes than cells, the nodes with the smallest ids fill up (and ValueError if there are fewer nodes).
    """
    nodes = nodes.select("id", "x")
    if nodes.limit(cells).count() < cells:
        raise ValueError("fewer nodes than cells")
    first = nodes.where("id is not null").agg(*[F.min_by(F.struct("id", "x"), F.struct(F.xxhash64(F.lit(s), "id"), "id")).alias(f"f{k}") for k, s in enumerate(seeds)]).first()
    found = [{row.id: np.array(row.x)} for row in first]
    fresh = [np.stack(list(f.values())) for f in found]
    table = stored(nodes.withColumn("gap", F.array(*[F.lit(float("inf"))] * len(seeds))), "gaps")
    for step in range(rounds + 1):
        wide = stored(table.select("id", "x", "gap").mapInArrow(_narrowed(fresh), "id long, x array<double>, gap array<double>, key string, value binary"), "gaps")
        discard(table)
        table = wide.where("id is not null")
        if step == rounds:
            break
        total = merged(wide.where("key is not null"))["gaps"]
        rate = np.where(total > 0, OVERSAMPLING * cells / rounds / np.maximum(total, 1e-300), 0.0)
        drawn: list[list[np.ndarray]] = [[] for _ in seeds]
        # in expectation OVERSAMPLING * cells / rounds rows a seed
        for r in table.mapInArrow(_kept(seeds, step, rate), "s int, id long, x array<double>").orderBy("s", "id").collect():
            if r.id not in found[r.s]:
                found[r.s][r.id] = np.array(r.x)
                drawn[r.s].append(found[r.s][r.id])
        fresh = [np.stack(d) if d else np.zeros((0, len(first[0].x))) for d in drawn]
    if any(len(f) < cells for f in found):
        # many nodes are equal: the farthest that are left, then the smallest ids
        for k, f in enumerate(found):
            if len(f) < cells:
                for r in table.orderBy(F.desc(F.element_at("gap", k + 1)), "id").limit(2 * cells).collect():
                    if len(f) < cells and r.id not in f:
                        f[r.id] = np.array(r.x)
    points = [np.stack([f[i] for i in sorted(f)]) for f in found]

    def weigh(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        x = matrix(batch.column("x"))
        for k, p in enumerate(points):
            near = np.concatenate([squared_distances(x[a : a + BLOCK], p).argmin(1) for a in range(0, len(x), BLOCK)])
            yield str(k), np.bincount(near, minlength=len(p)).astype(float)

    weights = sums(table.select("x"), weigh)
    discard(table)
    return [thinned(p, weights[str(k)], cells, seed, trials) for k, (p, seed) in enumerate(zip(points, seeds, strict=True))]


def nearest_cells(nodes: DataFrame, centres: Sequence[np.ndarray], name: str = "cells") -> DataFrame:
    """nodes with one cell for each set of centres: the nearest, the first of equals; one pass without a shuffle."""
    names = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                near = np.stack([np.concatenate([squared_distances(x[a : a + BLOCK], c).argmin(1) for a in range(0, len(x), BLOCK)]) for c in centres], 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(near.astype(np.int32))], [*names, name])

    return nodes.mapInArrow(run, StructType([*nodes.schema.fields, StructField(name, ArrayType(IntegerType()))]))
