"""Column helpers for array-of-double vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def squared_norm(a: Column | str) -> Column:
    return total(F.transform(col(a), lambda x: x * x))


def scaled(a: Column | str, by: Column) -> Column:
    return F.transform(col(a), lambda x: x * by)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def softmax(a: Column | str, temperature: Column | float = 1.0) -> Column:
    """exp(a/T) over its sum, shifted by the largest entry."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(col(a))
    e = F.transform(col(a), lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / total(e))


def log_sum_exp(a: Column | str) -> Column:
    top = F.array_max(col(a))
    return top + F.ln(total(F.transform(col(a), lambda x: F.exp(x - top))))


def one_hot(y: Column | str, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == col(y), 1.0).otherwise(0.0))


def first_smallest(costs: Column | str) -> Column:
    """Index from 0 of the smallest entry, the first of equals."""
    return F.array_position(col(costs), F.array_min(col(costs))).cast("int") - 1


def xlogy(x: Column, y: Column) -> Column:
    """x ln y, and 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def rounded(c: Column | str, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(col(c), places) + F.lit(0.0)


def rounded_all(a: Column | str, places: int = 6) -> Column:
    return F.transform(col(a), lambda x: F.round(x, places) + F.lit(0.0))
