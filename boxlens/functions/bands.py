"""Band labels and exact ratio rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_bands(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First ``(upper, label)`` with ``value <= upper`` wins, else ``otherwise``."""
    expr = None
    for upper, label in bounds:
        cond = value <= F.lit(upper)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def rank_bands(rank: Column, bounds: Sequence[int]) -> Column:
    """Disjoint rank bands; the label is the band's upper bound, NULL beyond."""
    expr = None
    for upper in bounds:
        cond = rank <= F.lit(upper)
        expr = F.when(cond, F.lit(upper)) if expr is None else expr.when(cond, F.lit(upper))
    return expr


def round_ratio_2(numerator: Column, denominator: Column) -> Column:
    """ROUND(a / b, 2) for non-negative integer counts, computed exactly.

    ``floor((200a + b) / 2b) / 100`` is half-up rounding of the exact rational
    a/b (23/40 -> 0.58, like Spark's ROUND of the division). Numerator and
    denominator are exact integers, so the one floating division cannot land
    on the wrong side of an integer. A zero or NULL denominator gives NULL.
    """
    a = numerator.cast("long")
    b = denominator.cast("long")
    return F.when(b > 0, F.floor((F.lit(200) * a + b) / (F.lit(2) * b)) / F.lit(100))
