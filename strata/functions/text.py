"""Text helpers: null tokens, case folding, fenced code blocks (PR13, PR14,
SC4, TX1, TX2)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_token(col, tokens: Sequence[str] = ("NULL",), blank_is_null: bool = True) -> Column:
    """Literal ``NULL`` (any case, padded) and, by default, blank text -> NULL."""
    c = _c(col)
    t = F.upper(F.trim(c))
    cond = t.isin([x.upper() for x in tokens])
    if blank_is_null:
        cond = cond | (t == F.lit(""))
    return F.when(cond, F.lit(None).cast("string")).otherwise(c)


def normalize_case(col, default: str | None = None) -> Column:
    """``upper(trim(x))``; NULL -> ``default`` when given."""
    out = F.upper(F.trim(_c(col)))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def strip_text(col) -> Column:
    """Strip leading / trailing Unicode white space (not only blanks)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def _fence(language: str | None) -> str:
    # Three or more backticks, a tag, its line, the body, the closing backticks.
    if language is None:
        # any first block; the tag match is case-sensitive here
        return r"(?s)`{3,}[^\n]*\n(.*?)\n`{3,}"
    return r"(?isu)`{3,}" + re.escape(language) + r"\b[^\n]*\n(.*?)\n`{3,}"


def extract_block(col, language: str = "python") -> Column:
    """Body of the first fenced block tagged ``language`` (case-insensitive,
    the tag may be followed by e.g. ``filename=...``); else the first fenced
    block of any language; else the whole text.  Outer white space stripped.

    Each pattern is matched once: the list of its blocks has no first element
    where there is none (``regexp_extract`` would give ``''`` for that and for an
    empty block alike), and a later pattern is only tried where it is needed.
    """
    c = _c(col)

    def first(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(1))

    return strip_text(F.coalesce(first(_fence(language)), first(_fence(None)), c))


def extract_pair(col, first: str = "sql", second: str = "yaml") -> Column:
    """TX2: ``struct(sql, yaml)`` from one reply.  Without a ``yaml`` fence
    (e.g. a ``yml`` tag) the fallback returns the first block, i.e. the SQL."""
    return F.struct(extract_block(col, first).alias(first), extract_block(col, second).alias(second))
