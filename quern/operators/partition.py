"""Iterative partitioners.  A sweep is one plan; state of the size of the cells is a small broadcast table, and the
assignment is checkpointed between sweeps, so the lineage stays short."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import vectors as v
from ..functions.stages import cut, stored
from ..functions.sums import cell_sums, matrix, sums
from . import assign, features, moments, scatter


def lloyd_step(n: DataFrame, centres: DataFrame) -> DataFrame:
    """(cell, c): means of the nodes nearest to each centre; a cell that gets none keeps its centre."""
    fresh = moments.means(assign.nearest_cell(n, centres), "x", "fresh")
    return centres.join(fresh, "cell", "left").select("cell", F.coalesce("fresh", "c").alias("c"))


def first_centres(n: DataFrame, cells: int) -> DataFrame:
    return n.where(F.col("id") < cells).select(F.col("id").cast("int").alias("cell"), F.col("x").alias("c"))


def spread_centres(n: DataFrame, cells: int, seed: int = 0) -> DataFrame:
    """k-means++ starting centres: each next one is drawn with probability in proportion to the distance so far,
    by the smallest -ln(u)/d with u from a hash of (seed, step, id), so the result doesn't depend on partitions."""

    def u(step: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "id"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)

    picked = [n.orderBy(u(0), "id").select("x").first().x]
    rows = n.select("id", "x").withColumn("gap", F.lit(float("inf")))
    for step in range(1, cells):
        last = F.array(*[F.lit(a) for a in picked[-1]])
        rows = rows.withColumn("gap", F.least("gap", v.squared_distance("x", last)))
        rows = cut(rows) if step % 2 == 0 else rows
        best = rows.where("gap > 0").orderBy(-F.ln(u(step)) / F.col("gap"), "id").select("x").first()
        if best is None:
            break
        picked.append(best.x)
    return n.sparkSession.createDataFrame(list(enumerate(picked)), "cell int, c array<double>")


def lloyd(n: DataFrame, centres: DataFrame, most_sweeps: int = 50) -> tuple[DataFrame, int]:
    """nodes with cell, and the sweeps made; stops when no node changes its cell.  An empty cell takes the node
    that is served worst among cells of more than one node.

    A sweep is one scan that places each node by the last centres and by the new ones, counts the changes and adds up the
    new cells; no assignment is stored between sweeps.
    """
    n = stored(n, "lloyd")
    fresh = np.array([r.c for r in centres.orderBy("cell").collect()], float)
    last, schema = fresh, StructType([*n.schema.fields, StructField("cell", IntegerType())])

    def near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)

    def placed(c: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = near(matrix(batch.column("x")), c) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], schema.names)

        return n.mapInArrow(run, schema)

    def swept(old: np.ndarray, new: np.ndarray) -> tuple[int, np.ndarray]:
        def kernel(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
            x = matrix(batch.column("x"))
            cell = near(x, new)
            yield "moves", np.array([float((near(x, old) != cell).sum())])
            yield "cells", cell_sums(np.concatenate((np.ones((len(x), 1)), x), 1), cell, len(new)).ravel()

        found = sums(n.select("x"), kernel)
        return int(found["moves"][0]), found["cells"].reshape(len(new), -1)

    _, total = swept(last, fresh)
    for sweep in range(1, most_sweeps + 1):
        size = total[:, :1]
        last, fresh = fresh, np.where(size > 0.5, total[:, 1:] / np.maximum(size, 1), fresh)
        if (size < 0.5).any():
            side = n.sparkSession.createDataFrame(list(enumerate(fresh.tolist())), "cell int, c array<double>")
            fresh = np.array([r.c for r in _refilled(placed(last), side).orderBy("cell").collect()])
        moves, total = swept(last, fresh)
        if not moves:
            return placed(fresh), sweep
    return placed(fresh), most_sweeps


def _refilled(placed: DataFrame, centres: DataFrame) -> DataFrame:
    size = placed.groupBy("cell").agg(F.count("*").alias("n"))
    empty = [r.cell for r in centres.join(size, "cell", "left_anti").orderBy("cell").collect()]
    if not empty:
        return centres
    far = placed.join(F.broadcast(centres.join(size.where("n > 1"), "cell")), "cell").withColumn("d", v.squared_distance("x", "c"))
    donors = far.orderBy(F.desc("d"), "id").select("x").limit(len(empty)).collect()
    moved = placed.sparkSession.createDataFrame([(c, r.x) for c, r in zip(empty, donors, strict=False)], "cell int, fresh array<double>")
    return centres.join(F.broadcast(moved), "cell", "left").select("cell", F.coalesce("fresh", "c").alias("c"))


def variance_partition(n: DataFrame) -> DataFrame:
    """Every node in one cell: the start of variance splitting."""
    return n.withColumn("cell", F.lit(0))


def variance_split(n: DataFrame, new_cell: int) -> DataFrame:
    """Splits the cell of largest scatter at the mean of its widest component; values above go to new_cell."""
    per = n.select("cell", F.posexplode("x").alias("dim", "v")).groupBy("cell", "dim").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    scatter = per.groupBy("cell").agg(F.round(F.sum(F.col("var") * F.col("n")), 9).alias("scatter")).orderBy(F.desc("scatter"), "cell").limit(1)
    cut = per.join(F.broadcast(scatter), "cell").orderBy(F.desc(F.round("var", 12)), "dim").limit(1).select(F.col("cell").alias("at"), "dim", "mean")
    over = (F.col("cell") == F.col("at")) & (F.element_at("x", F.col("dim") + 1) > F.col("mean"))
    return n.crossJoin(F.broadcast(cut)).withColumn("cell", F.when(over, new_cell).otherwise(F.col("cell"))).drop("at", "dim", "mean")


def divisive(n: DataFrame, cells: int) -> DataFrame:
    """cells - 1 variance splits."""
    placed = variance_partition(n)
    for new in range(1, cells):
        placed = cut(variance_split(placed, new))
    return placed


def scatter_cut(points: DataFrame, ranges: int = 256) -> DataFrame:
    """The cut of (id, p) into low and high values with the least summed scatter, between distinct values only:
    number below, largest value below and the gain.

    Equal values are summed first; sums are carried over ``ranges`` of values and then run inside each range, so no task
    orders all values.  The edges of the ranges are approximate and differ from one evaluation to the next, so ranges are
    stored and not found again.  Points without p come after all others, as in SQL: they count in the whole, and no cut is there.
    """
    per = points.where("p is not null").groupBy("p").agg(F.count("*").alias("k"))
    edges = F.percentile_approx("p", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("edges")
    per = per.crossJoin(F.broadcast(per.agg(edges))).select("p", "k", F.size(F.filter("edges", lambda e: e < F.col("p"))).alias("range"))
    per = stored(per, "ranged-values")
    whole = per.groupBy("range").agg(F.sum("k").alias("rn"), F.sum(F.col("k") * F.col("p")).alias("rs"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    before = whole.select("range", F.coalesce(F.sum("rn").over(ahead), F.lit(0)).alias("bn"), F.coalesce(F.sum("rs").over(ahead), F.lit(0.0)).alias("bs"))
    inside = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    run = per.join(F.broadcast(before), "range").select("p", (F.col("bn") + F.sum("k").over(inside)).alias("n"), (F.col("bs") + F.sum(F.col("k") * F.col("p")).over(inside)).alias("s"))
    every = points.agg(F.count("*").alias("total"), F.sum("p").alias("sum"))
    low, high = F.col("s") * F.col("s") / F.col("n"), (F.col("sum") - F.col("s")) * (F.col("sum") - F.col("s")) / (F.col("total") - F.col("n"))
    cuts = run.crossJoin(F.broadcast(every)).where("n < total").withColumn("gain", F.round(low + high - F.col("sum") * F.col("sum") / F.col("total"), 9))
    return cuts.orderBy(F.desc("gain"), "p").limit(1).select(F.col("n").alias("below"), F.col("p").alias("value"), "gain")


def widest_direction(block: DataFrame, power_steps: int = 100, tolerance: float = 1e-8) -> tuple[list[float], list[float], bool]:
    """Mean and leading axis of a cell's nodes by power iteration from its widest component, and whether it settled.

    The covariance is one pass over the cell; the iteration is on that small matrix.
    """
    mean = np.array(features.mean_vector(block).first()["mean"])
    cov = features.covariance(features.centred(block))
    axis = np.zeros(len(mean))
    axis[int(np.argmax(np.diag(cov)))] = 1.0
    settled = False
    for _ in range(power_steps):
        fresh = cov @ axis
        norm = np.linalg.norm(fresh)
        if norm == 0:
            break
        fresh /= norm
        change = min(np.linalg.norm(fresh - axis), np.linalg.norm(fresh + axis))
        axis = fresh
        if change <= tolerance:
            settled = True
            break
    if axis[np.argmax(np.abs(axis))] < 0:
        axis = -axis
    return mean.tolist(), axis.tolist(), settled


def principal_split(n: DataFrame, cells: int, least_scatter: bool = False) -> DataFrame:
    """cells - 1 splits of the cell of largest scatter along its leading axis: at its mean, or at the cut of least summed scatter
    along the axis.  If all nodes fall on one side, the lower half by projection stays."""
    placed = cut(variance_partition(n))
    for new in range(1, cells):
        per = placed.select("cell", F.posexplode("x").alias("dim", "v")).groupBy("cell", "dim").agg(F.var_pop("v").alias("var"), F.count("*").alias("n"))
        at = per.groupBy("cell").agg(F.round(F.sum(F.col("var") * F.col("n")), 9).alias("scatter"), F.max("n").alias("n")).where("n > 1").orderBy(F.desc("scatter"), "cell").first()
        if at is None:
            break
        own = placed.where(F.col("cell") == at.cell)
        mean, axis, _ = widest_direction(own)
        moved = v.minus("x", F.array(*[F.lit(m) for m in mean]))
        p = F.round(v.dot(moved, F.array(*[F.lit(m) for m in axis])), 12)
        points = own.select("id", p.alias("p"))
        limit = scatter.scatter_cut(own.select(p.alias("p"), moved.alias("x"))).first() if least_scatter else None
        value = 0.0 if not least_scatter else limit.value if limit else None
        above = points.where(F.col("p") > value).count() if value is not None else 0
        if 0 < above < at.n:
            over = F.col("p") > value
        else:
            half = points.orderBy("p", "id").limit(at.n // 2).orderBy(F.desc("p"), F.desc("id")).first()
            over = (F.col("p") > half.p) | ((F.col("p") == half.p) & (F.col("id") > half.id))
        placed = cut(placed.withColumn("p", p).withColumn("cell", F.when((F.col("cell") == at.cell) & over, new).otherwise(F.col("cell"))).drop("p"))
    return placed


def variance_sweep(n: DataFrame, vector: str) -> DataFrame:
    """nodes with target: the nearest cell mean of a vector, the own cell if none is nearer.

    The vector decides the objective: scaled features (variance), the joint embedding (normalised variance) or
    [sqrt(a) x, sqrt(b) q] (sum of variances).
    """
    cells = moments.means(n, vector, "c")
    cost = F.transform("cells", lambda k: v.squared_norm(k["c"]) - 2 * v.dot(F.col(vector), k["c"]))
    return n.crossJoin(F.broadcast(assign.packed(cells, "c"))).withColumn("costs", cost).withColumn("target", assign.keep_if_tied("costs", "cell")).drop("cells", "costs")


def repaired(n: DataFrame, cells: int, residual: F.Column | str) -> DataFrame:
    """nodes with every cell filled: each empty one, in order, takes the node of largest residual (then of smallest id) from a cell
    that has more than one node left.

    Nodes are passed over only as the last of their cell, so the 2 * cells with the largest residuals are enough.
    """
    size = {r.cell: r.n for r in moments.counts(n, cells).collect()}
    empty = sorted(c for c, k in size.items() if not k)
    if not empty:
        return n
    worst = n.withColumn("r", residual if isinstance(residual, F.Column) else F.col(residual)).orderBy(F.desc("r"), "id").limit(2 * cells)
    donors, given = iter(sorted(worst.select("id", "cell", "r").collect(), key=lambda r: (-r.r, r.id))), []
    for cell in empty:
        donor = next((r for r in donors if size[r.cell] > 1), None)
        if donor is None:
            raise ValueError("fewer nodes than cells")
        size[donor.cell] -= 1
        given.append((donor.id, cell))
    side = n.sparkSession.createDataFrame(given, "id long, given int")
    return cut(n.join(F.broadcast(side), "id", "left").withColumn("cell", F.coalesce("given", "cell").cast("int")).drop("given").select(*n.columns))


def variance_partition_loop(n: DataFrame, cells: int, vector: str, most_sweeps: int = 50) -> tuple[DataFrame, list[float], str]:
    """Sweeps of variance_sweep until no node changes its cell; the within-cell variance of the vector must not rise.
    Cells that are empty at the start take the nodes of largest norm."""
    n, history = cut(repaired(cut(n), cells, v.squared_norm(vector))), []
    for _ in range(most_sweeps):
        means = moments.means(n, vector, "c").join(n.groupBy("cell").agg(F.count("*").alias("n")), "cell")
        j = moments.within_variance(n, means, vector, "c").first().variance
        if history and j > history[-1] + 1e-9 * max(1.0, abs(history[-1])):
            raise RuntimeError("the objective rose")
        history.append(j)
        rows = cut(variance_sweep(n, vector))
        if rows.where("target <> cell").isEmpty():
            return n, history, "assignment_stable"
        moved = rows.join(F.broadcast(means), "cell").withColumn("residual", v.squared_distance(vector, "c")).drop("c", "n")
        n = cut(repaired(cut(moved.withColumn("cell", F.col("target"))), cells, "residual").drop("target", "residual"))
    return n, history, "iteration_limit"


def divergence_partition(n: DataFrame, cells: int, weight: float, most_sweeps: int = 50) -> tuple[DataFrame, list[float], str]:
    """Sweeps of divergence_proposal until nothing changes, empty cells repaired by the node of largest cost (at the start,
    of largest norm)."""
    n, history = cut(repaired(cut(n), cells, v.squared_norm("x"))), []
    for _ in range(most_sweeps):
        own = moments.representatives(n)
        j = moments.within_variance(n, own, "x", "c").crossJoin(moments.label_divergence(n)).select((F.col("variance") + weight * F.col("kl")).alias("j")).first().j
        if history and j > history[-1] + 1e-9 * max(1.0, abs(history[-1])):
            raise RuntimeError("the objective rose")
        history.append(j)
        rows = cut(divergence_proposal(n, weight).withColumn("residual", F.array_min("costs") + v.squared_norm("x")).drop("costs"))
        if rows.where("target <> cell").isEmpty():
            return n, history, "assignment_stable"
        n = cut(repaired(cut(rows.withColumn("cell", F.col("target"))), cells, "residual").drop("target", "residual"))
    return n, history, "iteration_limit"


def moment_state(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (cell, n, c, s) and one row with the residual moment as rows g and its norm."""
    cells = moments.representatives(n)
    m = moments.residual_moment(n, cells)
    rows = m.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "m"))), lambda e: e["m"]).alias("row"), F.sum(F.col("m") * F.col("m")).alias("sq"))
    one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda e: e["row"]).alias("m"), F.sqrt(F.sum("sq")).alias("norm"))
    return cells, one


def moment_proposal(n: DataFrame, weight: float) -> DataFrame:
    """nodes with target: the cell of least cost |c|^2 - 2 x.c + weight (c'Gs - x.Gs - q.G'c), G = M/|M| (0 for M = 0).

    Per cell this is a constant and two vectors, found from the cells alone, so each node needs two dot products.
    """
    cells, one = moment_state(n)
    g = F.when(F.col("norm") > 0, F.transform("m", lambda r: F.transform(r, lambda x: x / F.col("norm")))).otherwise(F.transform("m", lambda r: F.transform(r, lambda x: x * 0)))
    side = cells.crossJoin(F.broadcast(one)).withColumn("g", g).withColumn("gs", F.transform("g", lambda r: v.dot(r, F.col("s"))))
    gc = F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: v.dot(F.transform("g", lambda r: F.element_at(r, k)), F.col("c")))
    side = side.withColumn("gc", gc)
    side = side.select("cell", F.zip_with("c", "gs", lambda c, s: 2 * c + weight * s).alias("u"), v.scaled("gc", F.lit(weight)).alias("w"), (v.squared_norm("c") + weight * v.dot("c", "gs")).alias("b"))
    cost = F.transform("cells", lambda k: k["b"] - v.dot(F.col("x"), k["u"]) - v.dot(F.col("q"), k["w"]))
    return n.crossJoin(F.broadcast(assign.packed(side, "u", "w", "b"))).withColumn("costs", cost).withColumn("target", assign.keep_if_tied("costs", "cell")).drop("cells")


def move_deltas(n: DataFrame, weight: float, target: F.Column) -> DataFrame:
    """(id, delta): the exact change of J = V + weight |M| if the node alone moved to target."""
    cells, one = moment_state(n)
    size = n.agg(F.count("*").alias("total"))
    own = cells.select("cell", F.col("n").alias("na"), F.col("c").alias("ca"), F.col("s").alias("sa"))
    to = cells.select(F.col("cell").alias("target"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("s").alias("sb"))
    rows = n.withColumn("target", target).where("target <> cell").join(F.broadcast(own), "cell").join(F.broadcast(to), "target").where("na > 1")
    rows = rows.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(size))
    rows = rows.withColumn("ua", v.minus("x", "ca")).withColumn("va", v.minus("q", "sa")).withColumn("ub", v.minus("x", "cb")).withColumn("vb", v.minus("q", "sb"))
    a, b = F.col("na") / (F.col("na") - 1) / F.col("total"), F.col("nb") / (F.col("nb") + 1) / F.col("total")

    def through(u: str, w: str):
        return v.total(F.zip_with(u, "m", lambda x, r: x * v.dot(r, F.col(w))))

    square = F.col("norm") * F.col("norm") + 2 * (b * through("ub", "vb") - a * through("ua", "va"))
    square = square + b * b * v.squared_norm("ub") * v.squared_norm("vb") + a * a * v.squared_norm("ua") * v.squared_norm("va") - 2 * a * b * v.dot("ua", "ub") * v.dot("va", "vb")
    delta = b * v.squared_norm("ub") - a * v.squared_norm("ua") + weight * (F.sqrt(F.greatest(square, F.lit(0.0))) - F.col("norm"))
    return rows.select("id", delta.alias("delta"))


def moment_partition(n: DataFrame, weight: float, most_sweeps: int = 20, backtracks: int = 4, atol: float = 1e-12, rtol: float = 1e-10) -> tuple[DataFrame, list[float], str]:
    """Sweeps of moment_proposal from the given cells.  A proposal is accepted if J falls by more than
    atol + rtol max(1, |J|); else the half, quarter, ... of moves with the largest predicted gain are tried.
    Returns nodes, the objective after each sweep and a status."""
    n = cut(n)
    history = [moments.moment_objective(n, weight).first().j]
    cells = n.select("cell").distinct().count()
    for _ in range(most_sweeps):
        rows = moment_proposal(n, weight)
        gain = F.element_at("costs", F.col("cell") + 1) - F.element_at("costs", F.col("target") + 1)
        rows = cut(rows.withColumn("gain", F.when(F.col("target") != F.col("cell"), gain)).drop("costs"))
        moves = rows.where("gain is not null").count()
        if not moves:
            return n, history, "no_proposal"
        for k in range(backtracks + 1):
            take = moves >> k
            if not take:
                break
            chosen = rows.where("gain is not null").orderBy(F.desc("gain"), "id").limit(take).select("id", F.col("target").alias("to")) if k else rows.where("gain is not null").select("id", F.col("target").alias("to"))
            trial = cut(rows.drop("target", "gain").join(chosen, "id", "left").withColumn("cell", F.coalesce("to", "cell")).drop("to"))
            if trial.select("cell").distinct().count() < cells:
                continue
            j = moments.moment_objective(trial, weight).first().j
            if j < history[-1] - (atol + rtol * max(1.0, abs(history[-1]))):
                n, history = trial, [*history, j]
                break
        else:
            return n, history, "filtered_rejected"
        if not take:
            return n, history, "filtered_rejected"
    return n, history, "iteration_limit"


def divergence_proposal(n: DataFrame, weight: float) -> DataFrame:
    """nodes with target: least |c|^2 - 2 x.c + weight KL(q|s); infinite where q > 0 and s = 0."""
    cells = moments.representatives(n)
    kl = F.transform("cells", lambda k: v.total(F.zip_with("q", k["s"], lambda q, s: F.when(q == 0, 0.0).when(s <= 0, float("inf")).otherwise(q * F.ln(q / F.when(s > 0, s).otherwise(1.0))))))
    cost = F.zip_with(F.transform("cells", lambda k: v.squared_norm(k["c"]) - 2 * v.dot(F.col("x"), k["c"])), kl, lambda a, b: a + weight * b)
    return n.crossJoin(F.broadcast(assign.packed(cells, "c", "s"))).withColumn("costs", cost).withColumn("target", assign.keep_if_tied("costs", "cell")).drop("cells")
