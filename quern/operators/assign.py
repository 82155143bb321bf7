"""Hard and soft assignment of nodes to cells.  Centres travel as one broadcast row, so no node is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v


def packed(centres: DataFrame, *columns: str) -> DataFrame:
    """One row: the cells' structs in cell order.  Cells number a few hundred at most by construction."""
    return centres.agg(F.array_sort(F.collect_list(F.struct("cell", *columns))).alias("cells"))


def with_costs(n: DataFrame, centres: DataFrame) -> DataFrame:
    """nodes with costs: squared distance to each centre (cell, c), less the node's own norm, which is the same for all."""
    cost = F.transform("cells", lambda c: v.squared_norm(c["c"]) - 2 * v.dot(F.col("x"), c["c"]))
    return n.crossJoin(F.broadcast(packed(centres, "c"))).withColumn("costs", cost).drop("cells")


def nearest_cell(n: DataFrame, centres: DataFrame, name: str = "cell") -> DataFrame:
    return with_costs(n, centres).withColumn(name, v.first_smallest("costs")).drop("costs")


def keep_if_tied(costs: Column | str, old: Column | str) -> Column:
    """The current cell if nothing is cheaper, else the first cheapest."""
    costs, old = v.col(costs), v.col(old)
    return F.when(F.element_at(costs, old + 1) <= F.array_min(costs), old).otherwise(v.first_smallest(costs))


def smoothed_logits(cell: Column | str, cells: int, mixing: float) -> Column:
    """ln(mix/m) off the own cell, ln(1 - mix + mix/m) on it."""
    own, off = F.ln(F.lit(1 - mixing + mixing / cells)), F.ln(F.lit(mixing / cells))
    return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda j: F.when(j == v.col(cell), own).otherwise(off))


def prototype_logits(n: DataFrame, centres: DataFrame, tau: float) -> DataFrame:
    """(2 x.c - |c|^2) / tau for each cell."""
    return with_costs(n, centres).withColumn("logits", F.transform("costs", lambda c: -c / tau)).drop("costs")


def sparse_candidates(n: DataFrame, centres: DataFrame, k: int, mixing: float) -> DataFrame:
    """(id, cand, p): the own cell and the k - 1 nearest others, with 1 - mix + mix/k on the own and mix/k on each other."""
    ranked = F.array_sort(F.transform("costs", lambda c, j: F.struct(F.when(j == F.col("cell"), F.lit(0)).otherwise(1).alias("other"), F.round(c, 12).alias("cost"), j.alias("j"))))
    cand = F.transform(F.slice(ranked, 1, k), lambda e: e["j"])
    p = F.transform("cand", lambda j: F.when(j == F.col("cell"), 1 - mixing + mixing / k).otherwise(mixing / k))
    return with_costs(n, centres).withColumn("cand", cand).withColumn("p", p).select("id", "cand", "p")


def gap_scaled_logits(n: DataFrame, centres: DataFrame) -> DataFrame:
    """Minus the cost over the lower median of positive gaps between the two cheapest cells."""
    rows = with_costs(n, centres).withColumn("two", F.slice(F.array_sort("costs"), 1, 2))
    rows = rows.withColumn("gap", F.element_at("two", 2) - F.element_at("two", 1)).drop("two")
    scale = rows.where("gap > 0").agg(F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)"), F.lit(1.0)).alias("scale"))
    rows = rows.crossJoin(F.broadcast(scale))
    return rows.withColumn("logits", F.transform("costs", lambda c: -c / F.col("scale"))).drop("costs", "gap")


def distance_base(n: DataFrame, centres: DataFrame, tau: float, normalised: bool) -> DataFrame:
    """-d/tau per cell: each row less its smallest distance, or less its mean and over the RMS of all."""
    rows = with_costs(n, centres).withColumn("d", F.transform("costs", lambda c: c + v.squared_norm("x"))).drop("costs")
    if not normalised:
        low = F.array_min("d")
        return rows.withColumn("logits", F.transform("d", lambda c: -(c - low) / tau)).drop("d")
    mean = v.total("d") / F.size("d")
    rows = rows.withColumn("d", F.transform("d", lambda c: c - mean))
    rms = rows.agg(F.sqrt(F.sum(v.squared_norm("d")) / F.sum(F.size("d"))).alias("rms"))
    rows = rows.crossJoin(F.broadcast(rms))
    return rows.withColumn("logits", F.transform("d", lambda c: -c / F.greatest("rms", F.lit(1e-12)) / tau)).drop("d", "rms")


def kernel_labels(neighbours: DataFrame, labels: DataFrame, classes: int, sigma: float, beta: float) -> DataFrame:
    """(id, c, p) from neighbours (id, other, d2): (sum of weights of class c + beta / C) / (sum of weights + beta)."""
    w = F.exp(-F.col("d2") / (2 * sigma * sigma))
    seen = neighbours.join(labels.select(F.col("id").alias("other"), F.col("y").alias("c")), "other").groupBy("id", "c").agg(F.sum(w).alias("w"))
    total = seen.groupBy("id").agg(F.sum("w").alias("t"))
    grid = total.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    return grid.join(seen, ["id", "c"], "left").select("id", "c", ((F.coalesce("w", F.lit(0.0)) + beta / classes) / (F.col("t") + beta)).alias("p"))


def balanced(n: DataFrame, cells: int, steps: int) -> DataFrame:
    """(id, p): softmax of logits minus column duals after ``steps`` Sinkhorn steps towards equal cell masses."""
    duals = n.limit(1).select(F.transform(F.sequence(F.lit(1), F.lit(cells)), lambda _: F.lit(0.0)).alias("dual"))
    for _ in range(steps):
        p = v.softmax(F.zip_with("logits", "dual", lambda a, d: a - d))
        mass = n.crossJoin(F.broadcast(duals)).select(F.posexplode(p).alias("cell", "p"), "dual").groupBy("cell").agg(F.avg("p").alias("m"), F.max(F.element_at("dual", F.col("cell") + 1)).alias("d"))
        fresh = mass.select("cell", (F.col("d") + F.ln(F.col("m") * cells)).alias("d"))
        duals = fresh.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "d"))), lambda e: e["d"]).alias("dual"))
        duals = duals.select(F.transform("dual", lambda d: d - v.total("dual") / cells).alias("dual"))
    return n.crossJoin(F.broadcast(duals)).select("id", v.softmax(F.zip_with("logits", "dual", lambda a, d: a - d)).alias("p"))
