"""Numeric helpers whose rounding matches the warehouse SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec2(c) -> Column:
    """DOUBLE -> DECIMAL(10,2) rounding on the binary value (1.005 -> 1.00, 0.125 -> 0.13).

    A plain Spark cast rounds the shortest decimal text instead (1.005 -> 1.01).
    """
    return (F.round(_col(c).cast("double") * 100) / 100).cast("decimal(10,2)")


def int_half_even(c) -> Column:
    """DOUBLE -> INT rounding half to even (2.5 -> 2, 1.5 -> 2); Spark's cast truncates."""
    return F.rint(_col(c).cast("double")).cast("int")


def clamp_zero(c) -> Column:
    """GREATEST(x, 0): negatives and NULL become 0, NaN stays NaN."""
    return F.greatest(_col(c), F.lit(0.0))


def safe_div(num, den) -> Column:
    """num / NULLIF(den, 0) in floating point (NULL instead of an ANSI error)."""
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


def as_double(c) -> Column:
    return _col(c).cast("double")
