"""Vector expressions; sums run from left to right, so results are the same in any engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def l2(x: Column | str, y: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def projected(x: Column | str, matrix) -> Column:
    """x times a matrix (dimensions x t) of literals."""
    return F.array(*(_sum(F.zip_with(x, literal(column), lambda p, q: p * q)) for column in matrix.T))


def cells(proj: Column | str, shift: Sequence[float] | Column) -> Column:
    """Integer cells of a grid with a shift; halves go away from zero."""
    shift = shift if isinstance(shift, Column) else literal(shift)
    return F.zip_with(proj, shift, lambda p, s: F.round(p - s).cast("bigint"))


def off_centre(proj: Column | str, shift: Column) -> Column:
    """Distance of a projection from the centre of its cell."""
    return F.sqrt(_sum(F.zip_with(proj, shift, lambda p, s: ((F.round(p - s) + s) - p) * ((F.round(p - s) + s) - p))))
