"""A place in a plan that filters don't pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def barrier(df: DataFrame) -> DataFrame:
    """df through a generator of one row.

    The optimizer moves a filter below a projection by putting expressions in place of columns. Where columns build on each
    other, as in page verdicts, that computes everything below many times over; above a generator the filter stays.
    """
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("__row")).select("__row.*")
