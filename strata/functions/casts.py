"""Exact casts (SC9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_decimal(col, precision: int = 18, scale: int = 2) -> Column:
    """Text or number -> ``decimal(p,s)``; a misfit (``FREE``) gives NULL."""
    c = _c(col)
    return F.trim(c.cast("string")).try_cast(DecimalType(precision, scale))


def try_int(col) -> Column:
    return F.trim(_c(col).cast("string")).try_cast(IntegerType())
