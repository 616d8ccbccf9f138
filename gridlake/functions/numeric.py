"""Null-safe arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    big = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (F.abs(x) != big), x)


def filled(x: Column, no_data: float) -> Column:
    """x with null, NaN and infinite values replaced."""
    return F.coalesce(finite(x), F.lit(float(no_data)))


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    """x inside [low, high]; null stays null, NaN becomes ``high``.

    ``x`` is named as seldom as can be: expressions nest, and each name of it is a copy in the generated code."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return out if out is x else F.when(x.isNotNull(), out)


def stretch(x: Column, source: tuple[float, float], target: tuple[float, float]) -> Column:
    """Linear map of a clamped range onto another."""
    (a, b), (c, d) = source, target
    return (clamp(x, a, b) - a) * ((d - c) / (b - a)) + c
