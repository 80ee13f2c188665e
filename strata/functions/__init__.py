"""Column-level building blocks (``Column -> Column``), all Spark built-ins."""

from strata.functions.casts import try_decimal, try_int
from strata.functions.codes import map_codes
from strata.functions.dates import DEFAULT_TS_FORMATS, parse_date, parse_ts
from strata.functions.items import ITEM_TYPE, items_total, parse_items
from strata.functions.keys import md5_key, sha_key
from strata.functions.text import (extract_block, extract_pair, normalize_case, null_if_token,
                                   strip_text)

__all__ = [
    "DEFAULT_TS_FORMATS", "ITEM_TYPE", "extract_block", "extract_pair", "items_total", "map_codes",
    "md5_key", "normalize_case", "null_if_token", "parse_date", "parse_items",
    "parse_ts", "sha_key", "strip_text", "try_decimal", "try_int",
]
