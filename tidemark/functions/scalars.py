"""Scalar column helpers that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sdiv(a, b) -> Column:
    """a / b with NULL instead of an error when b is zero (ANSI mode raises)."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a.cast("double"), b.cast("double"))


def clean_double(c) -> Column:
    """NaN and infinities become NULL: there is one missing value."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def double_array(values) -> Column:
    """A constant array<double> column."""
    return F.array(*[F.lit(float(v)) for v in values])
