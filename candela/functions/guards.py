"""Null-safe arithmetic: missing is always NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def div(a, b) -> Column:
    """``a / b``; NULL where ``b`` is zero."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def div0(a, b) -> Column:
    """``a / b``; 0 where it is undefined."""
    return F.coalesce(div(a, b), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clean(column) -> Column:
    """Turn NaN and infinities into NULL."""
    x = c(column)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def pct_change(now, before) -> Column:
    return div(c(now) - c(before), before)


def ln_or_null(column) -> Column:
    return F.when(c(column) > 0, F.log(c(column)))
