"""Keep-latest deduplication (W1, SO1, SO3).

``row_number() = 1`` over the key lets Catalyst insert a partial
``WindowGroupLimit`` *before* the shuffle, so each map task forwards at
most one row per key: a key holding a third of all rows reaches its
reducer as one row per map task, not as a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def _desc(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c).desc_nulls_last()


def _orderable(t: DataType) -> bool:
    if isinstance(t, ArrayType):
        return _orderable(t.elementType)
    if isinstance(t, StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return not isinstance(t, (MapType, VariantType))


def latest_order(df: DataFrame, keys: Sequence[str], order: Sequence) -> list[Column]:
    """The given ordering (strings mean ``DESC NULLS LAST``), then every other
    column that can be ordered (arrays and structs too), by name, likewise: a
    total order, so the kept row never depends on file or partition order.
    Only rows that differ in map columns alone are left to chance."""
    return [_desc(c) for c in [*order, *total_order(df, keys, order)]]


def total_order(df: DataFrame, keys: Sequence[str], order: Sequence) -> list[str]:
    """The columns that decide where ``order`` does not: all others that can be ordered, by name."""
    done = {*keys, *(c for c in order if isinstance(c, str))}
    return sorted(f.name for f in df.schema.fields if f.name not in done and _orderable(f.dataType))


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence,
                rank_col: str = "_rn") -> DataFrame:
    """One row per ``keys``: the first by ``order`` (latest first)."""
    w = Window.partitionBy(*keys).orderBy(*latest_order(df, keys, order))
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) == 1)
              .drop(rank_col))


def superseded(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The rows ``keep_latest`` drops: the input minus the kept rows as a
    multiset (``EXCEPT ALL``).  That is a group-by over whole rows with
    map-side combining, so neither a hot key nor a hot group of exact
    copies is gathered by one task, and the result does not depend on
    which of several exact copies was kept.  Map-typed columns cannot be
    grouped."""
    return df.exceptAll(keep_latest(df, keys, order))
