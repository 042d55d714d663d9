"""Rounding and means as reports show them; decisions use the unrounded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    return F.bround(x, digits)


def safe_mean(x: Column, digits: int = 4) -> Column:
    """Aggregate: mean of the rounded values that are not null, rounded; null of none.

    Rounded values are summed as whole numbers, so the sum is exact and doesn't depend on the order of rows.
    """
    scale = 10**digits
    return F.bround(F.try_divide(F.sum(F.round(F.bround(x, digits) * scale).cast("long")).cast("double"), F.count(x) * F.lit(float(scale))), digits)


def failure_limit(pages: Column, fraction: float, minimum: int) -> Column:
    """Critical pages from which a document fails."""
    return F.greatest(F.lit(minimum).cast("long"), F.ceil(pages * F.lit(fraction).cast("double")).cast("long"))
