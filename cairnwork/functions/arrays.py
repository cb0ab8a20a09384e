"""Column functions on arrays of doubles; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fix_length(x: Column, n: int) -> Column:
    """The first n values, padded with 0 on the right."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def finite_or_zero(v: Column) -> Column:
    """0 for NaN and both infinities; null stays null."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def nonfinite_to_zero(x: Column) -> Column:
    return F.transform(x, finite_or_zero)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def logsumexp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def softmax(x: Column) -> Column:
    """Stable: the maximum is subtracted first."""
    raised = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    # the sum is bound once, as the one element of an array
    return F.flatten(F.transform(F.array(F.struct(raised.alias("e"), total(raised).alias("s"))), lambda r: F.transform(r["e"], lambda v: v / r["s"])))


def argmax(x: Column) -> Column:
    """Position (from 0) of the first maximum."""
    return F.array_position(x, F.array_max(x)) - 1


def scaled(x: Column, by: float | Column) -> Column:
    by = F.lit(by) if isinstance(by, (int, float)) else by
    return F.transform(x, lambda v: v * by)


def added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)
