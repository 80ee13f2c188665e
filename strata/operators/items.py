"""Line items: explode and reconcile against the header (SC12, G3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.items import items_total, parse_items


def explode_items(df: DataFrame, items_col: str = "items", keep: Sequence[str] | None = None,
                  raw_col: str | None = None) -> DataFrame:
    """One row per line item; ``inline_outer`` keeps orders without items
    (one row, NULL item fields).  ``raw_col`` parses text on the fly."""
    src = df
    if raw_col is not None:
        src = src.withColumn(items_col, parse_items(raw_col))
    keep = list(keep) if keep is not None else [c for c in df.columns if c != items_col]
    return src.select(*keep, F.posexplode_outer(items_col).alias("item_pos", "_item")) \
              .select(*keep, "item_pos", "_item.*")


def item_reconciliation(df: DataFrame, amount_col: str = "gross_amount",
                        items_col: str = "items", raw_col: str | None = "raw_item_details") -> DataFrame:
    """G3: header amount vs sum of quantity x unit_price, per row, without a
    shuffle (an array fold inside the row)."""
    src = df
    if raw_col is not None and items_col not in df.columns:
        src = src.withColumn(items_col, parse_items(raw_col))
    tot = items_total(F.col(items_col))
    return (src.withColumn("items_total", tot)
               .withColumn("item_count", F.when(F.col(items_col).isNull(), F.lit(0))
                                         .otherwise(F.size(F.col(items_col))))
               .withColumn("amount_matches", F.coalesce(F.col(amount_col) == F.col("items_total"),
                                                         F.lit(False))))
