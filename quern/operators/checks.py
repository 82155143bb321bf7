"""Predicates, joins with enforced keys and set operations over score and grid tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df; its query fails at the first row that has a value of these columns that is not finite."""
    bad = reduce(lambda a, b: a | b, [~finite(c) for c in columns])
    for c in columns:
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"not finite: {', '.join(columns)}")).cast("double")).otherwise(F.col(c)))
    return df


def with_all(df: DataFrame, by: str, value: str, expected: int) -> DataFrame:
    """Rows of the groups that have ``expected`` different values."""
    whole = df.groupBy(by).agg(F.count_distinct(value).alias("k")).where(F.col("k") == expected).select(by)
    return df.join(whole, by, "left_semi")


def close(a: Column | str, b: Column | str, eps: float = 1e-12) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.abs(a - b) < eps


def repeated(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys that come more than once."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], kind: str = "one_to_one", how: str = "inner") -> DataFrame:
    """Equi-join; raises if right (and left too for one_to_one) repeats a key."""
    for side, name in ((left, "left"), (right, "right")):
        if (name == "right" or kind == "one_to_one") and not repeated(side, on).isEmpty():
            raise ValueError(f"{name} side repeats a key of {list(on)}")
    return left.join(right, list(on), how)


def members(candidates: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """candidates; raises if one isn't in the grid or comes twice."""
    if not candidates.join(grid, list(keys), "left_anti").isEmpty():
        raise ValueError("a candidate is not in the grid")
    if not repeated(candidates, keys).isEmpty():
        raise ValueError("a candidate comes twice")
    return candidates.join(grid.select(*keys), list(keys), "left_semi")


def shared_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of both (search and final seeds must share none)."""
    return a.intersect(b)


def appended(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all, columns by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unique_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, place) of the different values by first appearance, places from 0.  Values are few (grid values)."""
    first = df.groupBy(value).agg(F.min(order).alias("first"))
    return first.select(value, (F.row_number().over(Window.orderBy("first")) - 1).alias("place"))


def constant(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, different): a group's value, and where it is not the same in the whole group the number of values, else null."""
    rows = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(value).alias("n"))
    return rows.select(*by, F.col("low").alias(value), F.when(F.col("low") != F.col("high"), F.col("n")).alias("different"))


def require_constant(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value); raises if the value is not the same in a whole group."""
    found = constant(df, by, value)
    bad = found.where("different is not null").first()
    if bad is not None:
        raise ValueError(f"{value} is not constant in {[bad[c] for c in by]}")
    return found.drop("different")


def relative_error(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """|a - b| / max(|b|, eps) of two array columns."""
    norm = lambda x: F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda s, v: s + v))
    return norm(F.zip_with(a, b, lambda x, y: x - y)) / F.greatest(norm(b), F.lit(eps))
