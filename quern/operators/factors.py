"""Maps of nodes by small dense matrices and costs that stay factorised: the cell side travels with the task, nodes don't move."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import features, moments
from .assign import packed


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def mapped(n: DataFrame, function: Callable[[np.ndarray], np.ndarray], source: str = "x", name: str = "h") -> DataFrame:
    """(id, name): function applied to blocks of rows of the vectors."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = np.ascontiguousarray(function(rows_of(batch.column(source))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", name])

    return n.select("id", source).mapInArrow(blocks, f"id long, {name} array<double>")


def linear(weights: np.ndarray, bias: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: x @ weights + (0 if bias is None else bias)


def hidden(weights: np.ndarray, bias: np.ndarray, out: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """One hidden layer with ReLU."""
    return lambda x: np.maximum(x @ weights + bias, 0) @ out


def assignment_inputs(n: DataFrame, mode: str = "features+labels") -> DataFrame:
    """nodes with u, what an encoder reads."""
    return n.withColumn("u", F.col("x") if mode == "features" else F.concat("x", "q"))


def dual_logits(n: DataFrame, node_map: Callable, anchors: np.ndarray, cell_map: Callable) -> DataFrame:
    """(id, logits): inner products of mapped nodes and mapped anchors over the root of their width."""
    cells = cell_map(anchors)
    return mapped(n, lambda x: node_map(x) @ cells.T / np.sqrt(cells.shape[1]), name="logits")


def attention_logits(n: DataFrame, centres: np.ndarray, query: np.ndarray, key: np.ndarray, tau: float) -> DataFrame:
    """(id, logits): (x Q)(c K)' / (sqrt(r) tau)."""
    keys = centres @ key
    return mapped(n, lambda x: x @ query @ keys.T / (np.sqrt(query.shape[1]) * tau), name="logits")


def nystrom(n: DataFrame, anchors: DataFrame, kind: str = "rbf", jitter: float = 1e-8) -> DataFrame:
    """(id, phi) with phi(x) . phi(a) = kernel(x, a) for every anchor a: kernel values times the inverse Cholesky factor."""
    own = features.kernel_values(anchors, anchors, kind).orderBy("id").toPandas()["k"]  # anchors are few by contract
    gram = np.array(own.tolist(), float)
    factor = np.linalg.cholesky(gram + jitter * np.trace(gram) / len(gram) * np.eye(len(gram)))
    inverse = np.linalg.inv(factor).T
    return mapped(features.kernel_values(n, anchors, kind), linear(inverse), "k", "phi")


def low_rank_logits(u: DataFrame, cells: np.ndarray, base: F.Column | None = None) -> DataFrame:
    """u(id, u, ...) with logits u V' / sqrt(r), and base added; the N x m matrix exists only row by row."""
    side = u.sparkSession.createDataFrame([(cells.tolist(),)], "factors array<array<double>>")
    logits = F.transform("factors", lambda row: v.dot(F.col("u"), row) / float(np.sqrt(cells.shape[1])))
    rows = u.crossJoin(F.broadcast(side))
    return rows.withColumn("logits", logits if base is None else F.zip_with(logits, base, lambda a, b: a + b)).drop("factors")


def principal_axes(n: DataFrame, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``rank`` singular values of the nodes' matrix (not centred), squared and over N, and their axes."""
    values, axes = np.linalg.eigh(features.covariance(n))
    order = np.argsort(-values)[:rank]
    return values[order], axes[:, order]


def projected(n: DataFrame, rank: int) -> DataFrame:
    """(id, h): coordinates along the principal axes."""
    return mapped(n, linear(principal_axes(n, rank)[1]))


def balanced_factors(n: DataFrame, cells: np.ndarray, rank: int) -> tuple[DataFrame, np.ndarray]:
    """u(id, u) and V with u V' / sqrt(r) the best rank-r form of left x cells', singular values shared evenly.

    n holds left as x; the singular vectors come from the small Gram matrix that Spark sums.
    """
    size = n.count()
    gram = features.covariance(n) * size
    values, axes = np.linalg.eigh(cells @ gram @ cells.T)
    order = np.argsort(-values)[:rank]
    s = np.sqrt(np.maximum(values[order], 1e-30))
    right = axes[:, order]
    share = rank**0.25
    return mapped(n, linear(cells.T @ right / np.sqrt(s) * share), name="u"), right * np.sqrt(s) * share


def _scaled(rows: DataFrame) -> DataFrame:
    """(id, logits) over the lower median of positive gaps between each node's two largest."""
    rows = rows.withColumn("two", F.slice(F.sort_array("logits", asc=False), 1, 2)).withColumn("gap", F.element_at("two", 1) - F.element_at("two", 2))
    scale = rows.where("gap > 0").agg(F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)"), F.lit(1.0)).alias("scale"))
    return rows.crossJoin(F.broadcast(scale)).select("id", F.transform("logits", lambda x: x / F.col("scale")).alias("logits"))


def _by_factors(n: DataFrame, left: F.Column, right: DataFrame) -> DataFrame:
    """Gap-scaled left . (right - its mean over the cells) for right(cell, r); nothing of size N x m is stored."""
    mean = features.mean_vector(right, "r")
    centred = right.crossJoin(F.broadcast(mean)).select("cell", v.minus("r", "mean").alias("r"))
    rows = n.withColumn("left", left).crossJoin(F.broadcast(packed(centred, "r")))
    return _scaled(rows.select("id", F.transform("cells", lambda c: v.dot(F.col("left"), c["r"])).alias("logits")))


def feature_distance(n: DataFrame, vector: str = "x") -> DataFrame:
    """(id, logits): minus the squared distance to each cell's mean, centred over the cells and scaled by the median gap."""
    cells = moments.means(n, vector, "c").select("cell", F.concat("c", F.array(-v.squared_norm("c"))).alias("r"))
    return _by_factors(n, F.concat(v.scaled(vector, F.lit(2.0)), F.array(F.lit(1.0))), cells)


def moment_cost(n: DataFrame, weight: float) -> DataFrame:
    """(id, logits): minus the linearised moment objective, as [x, q, 1] times one vector a cell."""
    from .partition import moment_state

    cells, one = moment_state(n)
    g = F.transform("m", lambda r: F.transform(r, lambda x: x / F.greatest("norm", F.lit(1e-30))))
    side = cells.crossJoin(F.broadcast(one)).withColumn("g", g).withColumn("gs", F.transform("g", lambda r: v.dot(r, F.col("s"))))
    side = side.withColumn("cg", F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: v.dot(F.transform("g", lambda r: F.element_at(r, k)), F.col("c"))))
    last = F.array(-v.squared_norm("c") - weight * v.dot("cg", "s"))
    right = side.select("cell", F.concat(F.zip_with("c", "gs", lambda c, s: 2 * c + weight * s), v.scaled("cg", F.lit(weight)), last).alias("r"))
    return _by_factors(n, F.concat("x", "q", F.array(F.lit(1.0))), right)


def uniform(*parts: F.Column | str) -> F.Column:
    """A number in (0, 1) from the md5 of the parts as text: the same in every engine and partitioning."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def gaussian(*parts: F.Column | str) -> F.Column:
    """A standard normal number from two hash uniforms (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform(F.lit("r"), *parts))) * F.cos(2 * F.pi() * uniform(F.lit("a"), *parts))


def random_costs(n: DataFrame, cells: int, tau: float, seed: int = 0) -> DataFrame:
    """(id, logits): random costs, each row less its mean and all over their RMS, as the normalised distance base."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda j: gaussian(F.lit(seed), F.col("id"), j))
    rows = n.select("id", draw.alias("d")).withColumn("mean", v.total("d") / cells).select("id", F.transform("d", lambda x: x - F.col("mean")).alias("d"))
    rms = rows.agg(F.sqrt(F.sum(v.squared_norm("d")) / F.sum(F.size("d"))).alias("rms"))
    return rows.crossJoin(F.broadcast(rms)).select("id", F.transform("d", lambda x: -x / F.greatest("rms", F.lit(1e-12)) / tau).alias("logits"))


def random_balanced(n: DataFrame, cells: int, seed: int = 0) -> DataFrame:
    """nodes with cell = rank in a hash order mod cells.  Ranks are counted by the first digits of the hash, then inside."""
    from pyspark.sql import Window

    rows = n.withColumn("order", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))).withColumn("range", F.substring("order", 1, 3))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 ranges at most
    before = rows.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("order", "id")) - 1
    return rows.join(F.broadcast(before), "range").withColumn("cell", (place % cells).cast("int")).drop("order", "range", "before")
