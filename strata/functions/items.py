"""Embedded line-item lists ``[item_id:quantity:unit_price|...]`` (SC12, G3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DecimalType, IntegerType, LongType, StructField,
                               StructType)

# item_id is BIGINT: item ids in legacy text can be any catalogue key, and
# keys outgrow the INT range on large catalogues (a narrower type would
# turn them into NULLs).
ITEM_STRUCT = StructType([
    StructField("item_id", LongType()),
    StructField("quantity", IntegerType()),
    StructField("unit_price", DecimalType(18, 2)),
])
ITEM_TYPE = ArrayType(ITEM_STRUCT)

_LIST = r"^\[(.*)\]$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_items(col) -> Column:
    """Text list -> ``ARRAY<STRUCT<item_id BIGINT, quantity INT, unit_price DECIMAL(18,2)>>``.

    NULL, blank, ``NULL`` or an empty list give a NULL array.  A malformed
    field inside an item gives a NULL field, never an error.
    """
    s = F.trim(_c(col).cast("string"))
    inner = F.regexp_extract(s, _LIST, 1)
    parts = F.when(s.rlike(_LIST) & (F.trim(inner) != F.lit("")), F.split(inner, r"\|"))
    fields = F.transform(parts, lambda x: F.split(x, ":"))  # each item is split once

    def one(f):
        return F.struct(
            F.trim(F.try_element_at(f, F.lit(1))).try_cast(LongType()).alias("item_id"),
            F.trim(F.try_element_at(f, F.lit(2))).try_cast(IntegerType()).alias("quantity"),
            F.trim(F.try_element_at(f, F.lit(3))).try_cast(DecimalType(18, 2)).alias("unit_price"),
        )

    return F.transform(fields, one).cast(ITEM_TYPE)


def items_total(items_col) -> Column:
    """Sum of quantity x unit_price over the list (no items -> 0.00), as
    ``decimal(18,2)``; an array fold, so no shuffle.  A total that does not
    fit gives NULL, never an error."""
    zero = F.lit(0).cast(DecimalType(38, 2))
    line = lambda x: F.coalesce(
        (x["quantity"].cast(DecimalType(10, 0)) * x["unit_price"]).try_cast(DecimalType(38, 2)), zero)
    total = F.aggregate(F.coalesce(_c(items_col), F.array().cast(ITEM_TYPE)), zero,
                        lambda a, x: F.try_add(a, line(x)).try_cast(DecimalType(38, 2)))
    return total.try_cast(DecimalType(18, 2))
