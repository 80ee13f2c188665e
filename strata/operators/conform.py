"""Conforming projections (PR1-PR6, PR9, PR13, PR14, SC4).

All of these are narrow projections: no shuffle, one codegen stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strata.functions.codes import map_codes
from strata.functions.text import normalize_case


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Old -> conformed names; unmapped columns keep their name and place."""
    missing = [k for k in mapping if k not in df.columns]
    if missing:
        raise ValueError(f"rename: unknown columns {missing}")
    return df.withColumnsRenamed(dict(mapping))


_CAMEL_1 = re.compile(r"(.)([A-Z][a-z]+)")
_CAMEL_2 = re.compile(r"([a-z0-9])([A-Z])")
_NON_WORD = re.compile(r"[^0-9a-zA-Z]+")


def snake_case(name: str) -> str:
    """``CUST_ID`` -> ``cust_id``, ``custId`` -> ``cust_id``, ``Cust ID`` -> ``cust_id``."""
    s = _NON_WORD.sub("_", name.strip())
    s = _CAMEL_1.sub(r"\1_\2", s)
    s = _CAMEL_2.sub(r"\1_\2", s)
    return re.sub("_+", "_", s).strip("_").lower()


def snake_case_columns(df: DataFrame, explicit: Mapping[str, str] | None = None) -> DataFrame:
    """Rename every column to snake_case; ``explicit`` entries win.  Metadata
    only: names are computed on the driver from the schema, no data moves."""
    explicit = dict(explicit or {})
    names = [explicit.get(c, snake_case(c)) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"snake_case_columns: name clash in {names}")
    return df.toDF(*names)


def trim_strings(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Remove CHAR padding (blanks only, like SQL ``trim``) from string columns."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.trim(F.col(c)) for c in cols})


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """NULL -> default, with the literal cast to the column's own type."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dtypes[c]))
                           for c, v in defaults.items()})


def with_code_map(df: DataFrame, col: str, mapping: Mapping[str, str], default: str,
                  out: str | None = None, keep_raw_as: str | None = None,
                  trim: bool = False) -> DataFrame:
    """Map a code column to words; optionally keep the raw code beside it."""
    cols = {}
    if keep_raw_as:
        cols[keep_raw_as] = F.col(col)
    cols[out or col] = map_codes(col, mapping, default, trim=trim)
    return df.withColumns(cols)


def normalize_case_columns(df: DataFrame, cols: Mapping[str, str | None]) -> DataFrame:
    """``upper(trim(c))`` per column; the mapping value is the NULL default."""
    return df.withColumns({c: normalize_case(c, d) for c, d in cols.items()})
