"""Code -> description maps (PR5)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code maps of the two shipped sources.
PAYMENT_METHODS = {"cc": "Credit Card", "paypal": "PayPal", "giftcard": "Gift Card"}
ACCOUNT_TYPES = {"SV": "Savings", "CH": "Checking", "CD": "Certificate of Deposit"}
ACCOUNT_STATUSES = {"A": "Active", "I": "Inactive", "D": "Dormant"}

def map_codes(col, mapping: Mapping, default: str | None = None, trim: bool = False) -> Column:
    """Exact, case-sensitive code lookup; unmapped or NULL -> ``default``.

    One form whatever the number of codes: a literal map, probed by the text of
    the column (so a numeric code column works too).  A code that is mapped to
    ``None`` gives NULL, not the default.  Dictionaries that are data, not code,
    go through ``operators.joins.map_codes_join``."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    if trim:
        c = F.trim(c)
    if not mapping:
        return F.lit(default).cast("string")
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(v).cast("string"))])
    return F.when(c.isNotNull() & F.map_contains_key(m, F.coalesce(c, F.lit(""))),
                  F.try_element_at(m, c)).otherwise(F.lit(default))


def codes_for(mapping: Mapping[str, str], value: str) -> list[str]:
    """The codes that map to ``value`` -- lets a filter on the mapped column
    be written on the raw code, where Parquet can push it down."""
    return [k for k, v in mapping.items() if v == value]
