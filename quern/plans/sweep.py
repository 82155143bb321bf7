"""Sweeps: a grid of settings, each tried with several seeds, judged on validation rows only.

All settings that have no score yet are partitioned together, pass by pass, their heads fitted one task each and scored in one
scan of the nodes.  Scores are kept as Parquet under the fingerprint of the data and the setting, so a sweep that was
stopped goes on where it was and one over other nodes or another grid reads none of them; a setting that failed keeps its
error and is not tried again.  The winner is taken by mean score, then by place in the grid.  Test rows are read once,
for the winner.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import cut
from ..operators import batched, features, seeding, selection, students

SCHEMA = "candidate long, temperature double, weight double, condensation_seed int, student_seed int, step int, cells int, objective double, val_acc double, status string, error string, fingerprint string"


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def condense(n: DataFrame, settings: Sequence[batched.Setting], seeds: Sequence[int]) -> list[batched.Outcome]:
    """Outcomes of settings whose start is the nearest centre of their seed; n: id, x, logits."""
    each = sorted(set(seeds))
    centres = seeding.spread_centres(n, settings[0].cells, each)
    start = seeding.nearest_cells(n.select("id", "x", "logits"), centres, "near")
    start = start.withColumn("cells", F.array(*[F.element_at("near", each.index(s) + 1) for s in seeds])).drop("near")
    return batched.partition(start, settings)[1]


def run_sweep(spark: SparkSession, nodes: DataFrame, root: str, temperatures: Sequence[float], weights: Sequence[float], cells: int = 8, seeds: Sequence[int] = (0, 1, 2), penalty: float = 0.01, sweeps: int = 4, objective: str = "moment", kind: str = "filtered_batch") -> tuple[DataFrame, DataFrame, float]:
    """(scores, ranking, test accuracy of the winner) for nodes (id, x, y, split, logits)."""
    nodes = cut(features.rms_features(nodes, of=nodes.where("split = 'train'")))
    data = selection.content_digest(nodes, ["id", "y", "split", "x", "logits"]).first().asDict()
    asked = []
    for place, (t, weight) in enumerate(itertools.product(temperatures, weights)):
        for seed in seeds:
            mark = fingerprint({"data": data, "place": place, "t": t, "weight": weight, "seed": seed, "cells": cells, "penalty": penalty, "sweeps": sweeps, "objective": objective, "kind": kind})
            asked.append((place, float(t), float(weight), seed, mark))
    known = _known(spark, f"{root}/scores")
    todo = [a for a in asked if a[4] not in known]
    if todo:
        found, thetas, errors = _fitted(spark, nodes, todo, cells, penalty, sweeps, objective, kind)
        rows = []
        for (place, t, weight, seed, mark), o, m, e in zip(todo, found, students.metrics(nodes, thetas), errors, strict=True):
            rows.append((place, t, weight, seed, 0, 0, cells, o.history[-1] if o.history else None, m.get("val_acc"), o.status, o.error or e, mark))
        table = spark.createDataFrame(rows, SCHEMA).repartition(1).write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        table.partitionBy("fingerprint").parquet(f"{root}/scores")
    scores = spark.read.schema(SCHEMA).parquet(f"{root}/scores").where(F.col("fingerprint").isin([a[4] for a in asked])).dropDuplicates(["fingerprint"])
    ranking = selection.joint_score(scores.where("val_acc is not null"), ("candidate", "temperature", "weight", "step"))
    best = selection.best(ranking, [F.desc("val"), "candidate"]).first()
    if best is None:
        raise RuntimeError("no setting has a score")
    _, thetas, _ = _fitted(spark, nodes, [(best.candidate, best.temperature, best.weight, seeds[0], "")], cells, penalty, sweeps, objective, kind)
    return scores, ranking, students.metrics(nodes, thetas)[0]["test_acc"]


def _fitted(spark: SparkSession, nodes: DataFrame, todo: Sequence[tuple], cells: int, penalty: float, sweeps: int, objective: str, kind: str) -> tuple[list[batched.Outcome], list[np.ndarray | None], list[str | None]]:
    settings = [batched.Setting(cells, weight, t, objective, kind, most_sweeps=sweeps, backtracks=4) for _, t, weight, _, _ in todo]
    found = condense(nodes, settings, [seed for *_, seed, _ in todo])
    heads = students.fit_heads(spark, [None if o.counts is None else (o.counts, o.centres, o.labels) for o in found], penalty)
    return found, [t for t, _ in heads], [e for _, e in heads]


def _known(spark: SparkSession, path: str) -> set[str]:
    try:
        return {r.fingerprint for r in spark.read.schema(SCHEMA).parquet(path).select("fingerprint").distinct().collect()}
    except AnalysisException:
        return set()
