"""Missing-value and division rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN means missing; Spark would otherwise sort it last and count it."""
    c = as_column(c).cast("double")
    return F.when(~F.isnan(c), c)


def finite_or_zero(c: Column | str) -> Column:
    """NULL, NaN and both infinities become 0."""
    c = as_column(c).cast("double")
    # NULL compares to NULL and NaN is larger than everything, so only finite values pass.
    return F.when(F.abs(c) < F.lit(float("inf")), c).otherwise(F.lit(0.0))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den as double; ``default`` when the denominator is 0 or NULL."""
    q = num.cast("double") / F.when(den != 0, den.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def rounded(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)
