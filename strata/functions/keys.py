"""Surrogate keys (SC1-SC3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha_key(*cols, sep: str = "||", null_token: str | None = None) -> Column:
    """SHA-256 hex of the ``sep``-joined key columns.

    The default keeps ``concat_ws`` semantics (NULL parts are skipped, so
    ``(a, NULL)`` hashes like ``a``).  Pass ``null_token`` to put a marker
    in place of each NULL part instead, which keeps arities apart.
    """
    parts = [_c(c).cast("string") for c in cols]
    if null_token is not None:
        parts = [F.coalesce(p, F.lit(null_token)) for p in parts]
    return F.sha2(F.concat_ws(sep, *parts), 256)


def md5_key(col) -> Column:
    """MD5 hex of the space-trimmed key (CHAR padding does not change it)."""
    return F.md5(F.trim(_c(col).cast("string")))
