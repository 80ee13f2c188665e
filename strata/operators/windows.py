"""Rolling averages (W2, W3, SO2).

Both run *after* aggregation to one row per date (per partition key): a
window without ``partitionBy`` gathers its input in one task, which is
fine for a few thousand calendar days and never acceptable on raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_rows(df: DataFrame, value: str, order_by: str, n: int = 7,
                 partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Mean of ``value`` over the current row and the ``n-1`` rows before it
    (rows, not days: gaps in the dates are not filled)."""
    w = Window.partitionBy(*partition_by).orderBy(F.col(order_by).asc()).rowsBetween(-(n - 1), 0)
    return df.withColumn(out or f"rolling_{n}_avg_{value}", F.avg(F.col(value)).over(w))


def rolling_days(df: DataFrame, value: str, date_col: str, days: int = 7,
                 partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Mean of ``value`` over the rows dated within the last ``days`` calendar
    days (current day included); days without a row do not count."""
    w = (Window.partitionBy(*partition_by)
         .orderBy(F.unix_date(F.col(date_col).cast("date")))
         .rangeBetween(-(days - 1), 0))
    return df.withColumn(out or f"rolling_{days}d_avg_{value}", F.avg(F.col(value)).over(w))
