"""Score tables: grids, complete-pair checks, two-step averages, selection rules and ordered diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, space: dict[str, Sequence]) -> DataFrame:
    """Every combination of the values, with candidate = its place in product order (last key fastest)."""
    frames = [spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"{name}_at int, {name} {'string' if isinstance(values[0], str) else 'double' if isinstance(values[0], float) else 'long'}") for name, values in space.items()]
    out = reduce(DataFrame.crossJoin, frames)
    place = F.lit(0)
    for name, values in space.items():
        place = place * len(values) + F.col(f"{name}_at")
    return out.select(place.cast("long").alias("candidate"), *space)


def crossed(tried: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the values that occur in the columns, with candidate = its place (values in order, last column
    fastest).  Parameters have few values; nulls are left out."""
    out, place = None, F.lit(0)
    for c in columns:
        values = tried.where(F.col(c).isNotNull()).select(c).distinct()
        own = values.withColumn(f"{c}_at", F.row_number().over(Window.orderBy(c)) - 1).crossJoin(F.broadcast(values.agg(F.count("*").alias(f"{c}_n"))))
        out = own if out is None else out.crossJoin(F.broadcast(own))
        place = place * F.col(f"{c}_n") + F.col(f"{c}_at")
    return out.select(place.cast("long").alias("candidate"), *columns)


def missing_pairs(scores: DataFrame, firsts: Sequence[int], seconds: Sequence[int], first: str = "condensation_seed", second: str = "student_seed", by: Sequence[str] = ("candidate", "step")) -> DataFrame:
    """Groups whose (first, second) pairs aren't exactly those of the given seeds, each once: pairs found, distinct, unexpected and expected."""
    outside = ~F.col(first).isin(list(firsts)) | ~F.col(second).isin(list(seconds))
    seen = scores.groupBy(*by).agg(F.count("*").alias("found"), F.count_distinct(first, second).alias("distinct_pairs"), F.count_if(outside).alias("unexpected"))
    expected = F.lit(len(set(firsts)) * len(set(seconds))).cast("long")
    return seen.withColumn("expected", expected).where("found <> expected or distinct_pairs <> expected or unexpected > 0")


def joint_score(scores: DataFrame, keys: Sequence[str] = ("candidate", "step")) -> DataFrame:
    """Mean over condensation seeds of the means over student seeds, and the sample deviation of those means."""
    inner = scores.groupBy(*keys, "condensation_seed").agg(F.avg("val_acc").alias("mean"), F.stddev_samp("val_acc").alias("spread"), F.count("*").alias("n"))
    return inner.groupBy(*keys).agg(F.avg("mean").alias("val"), F.stddev_samp("mean").alias("val_std"), F.avg("spread").alias("student_std"), F.sum("n").alias("evaluations"))


def best(scores: DataFrame, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """The first row in the given order, over all or for each group."""
    if not by:
        return scores.orderBy(*order).limit(1)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return scores.withColumn("place", place).where("place = 1").drop("place")


def paired_change(scores: DataFrame, baseline: str, by: Sequence[str]) -> DataFrame:
    """Each candidate's mean and deviation of val_acc less the baseline's at the same seeds."""
    base = scores.where(F.col("candidate") == baseline).select(*by, F.col("val_acc").alias("base_acc"))
    change = scores.join(base, list(by)).withColumn("change", F.col("val_acc") - F.col("base_acc"))
    return change.groupBy("candidate").agg(F.avg("change").alias("mean_change"), F.stddev_samp("change").alias("std_change"), F.count("*").alias("pairs"))


def boundary_profile(scores: DataFrame, parameter: str) -> DataFrame:
    """Best score of each value of a parameter and where the value lies in its range."""
    top = scores.groupBy(F.col(parameter).alias("value")).agg(F.max("val_acc").alias("best"))
    ends = top.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.when(F.col("lo") == F.col("hi"), "fixed").when(F.col("value") == F.col("lo"), "lower").when(F.col("value") == F.col("hi"), "upper").otherwise("interior")
    return top.crossJoin(F.broadcast(ends)).select("value", "best", place.alias("position"))


def timing_summary(runs: DataFrame, baseline: str) -> DataFrame:
    """(name, n, median, std, most, speedup of the baseline's median over it) from (name, seconds)."""
    per = runs.groupBy("name").agg(F.count("*").alias("n"), F.median("seconds").alias("median"), F.stddev_samp("seconds").alias("std"), F.max("seconds").alias("most"))
    base = per.where(F.col("name") == baseline).select(F.col("median").alias("base"))
    return per.crossJoin(F.broadcast(base)).withColumn("speedup", F.try_divide("base", "median")).drop("base")


def running_best(history: DataFrame, run: str, step: str, value: str, smaller: bool = False) -> DataFrame:
    """Best value so far of each run, the change from the row before, and whether the last 10 rows brought nothing."""
    w = Window.partitionBy(run).orderBy(step)
    so_far = (F.min if smaller else F.max)(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = history.withColumn("best", so_far).withColumn("change", F.col(value) - F.lag(value).over(w))
    return rows.withColumn("plateau", F.coalesce(F.col("best") == F.lag("best", 10).over(w), F.lit(False)))


def new_rows(candidates: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(old.select(*keys), list(keys), "left_anti")


def fingerprint(config: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First 12 hex digits of the sha256 of the columns as JSON."""
    return config.withColumn("fingerprint", F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 12))


def content_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and order-free digests of the rows' text form."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    low = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.bit_xor(low).alias("xor_digest"), F.sum(low % 1_000_003).alias("sum_digest"))
