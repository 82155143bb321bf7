"""Sums of arrays over all rows: every task adds up its own, and the tasks' sums are added in two steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHAPE = "key string, value binary"
#: Tasks that add up the sums of all others: what they get is small, and an iteration waits for all of them.
MERGERS = 12
Kernel = Callable[[pa.RecordBatch], Iterable[tuple[str, np.ndarray]]]


def add_up(total: dict[str, np.ndarray], parts: Iterable[tuple[str, np.ndarray]]) -> None:
    for key, value in parts:
        total[key] = total[key] + value if key in total else value


def rows_of(total: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array(list(total), pa.string()), pa.array([np.ascontiguousarray(x, float).tobytes() for x in total.values()], pa.binary())]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        add_up(total, ((k, np.frombuffer(x.as_buffer(), float)) for k, x in zip(batch.column("key").to_pylist(), batch.column("value"), strict=True)))
    yield pa.RecordBatch.from_arrays(rows_of(total), ["key", "value"])


def merged(parts: DataFrame) -> dict[str, np.ndarray]:
    """The sum of each key's arrays, from parts (key, value as bytes of doubles).

    First as the shuffle happens to deal the parts, then by key: few tasks, as each adds the arrays as they stream by and holds
    one a key.
    """
    spread = min(MERGERS, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = parts.select("key", "value").repartition(spread).mapInArrow(_merge, SHAPE)
    twice = once.repartition(spread, "key").mapInArrow(_merge, SHAPE)
    return {r.key: np.frombuffer(bytes(r.value), float) for r in twice.collect()}  # one array a key


def sums(rows: DataFrame, kernel: Kernel) -> dict[str, np.ndarray]:
    """The sums over all batches of rows of what kernel gives for each: (key, array of a fixed shape for the key), flat.

    For state whose size doesn't grow with the rows: it comes to the driver.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add_up(total, kernel(batch))
        yield pa.RecordBatch.from_arrays(rows_of(total), ["key", "value"])

    return merged(rows.mapInArrow(own, SHAPE))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).ravel()))


def cell_sums(values: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Sums of the rows of values by cell: one product for few cells, else by sorting."""
    if cells <= 64:
        return (cell == np.arange(cells)[:, None]).astype(float) @ values
    out = np.zeros((cells, values.shape[1]))
    order = np.argsort(cell, kind="stable")
    head = np.flatnonzero(np.diff(cell[order], prepend=-1))
    if len(head):
        out[cell[order][head]] = np.add.reduceat(values[order], head, axis=0)
    return out
