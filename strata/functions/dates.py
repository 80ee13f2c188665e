"""Tolerant date / timestamp parsing (SC6-SC8).

Every parse is a ``try_*`` function: under ANSI mode a plain ``to_timestamp``
raises on the first text that does not match, so a ``coalesce`` of them
would never fall through to the next pattern.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered timestamp patterns of the transaction source.
# The first four are the shipped ones; ``yyyy/MM/dd`` and the day-first
# ``dd/MM/yyyy HH:mm:ss`` are added for values the fixture file contains.
# Order decides ambiguous text, so it is part of the contract.
DEFAULT_TS_FORMATS: tuple[str, ...] = (
    "yyyy/MM/dd HH:mm:ss",
    "dd-MMM-yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd/MM/yyyy HH:mm:ss",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_RUN = re.compile(r"([A-Za-z])\1*|[^A-Za-z]")
#: Runs of pattern letters whose every text this regex admits.
_TOKENS = {**dict.fromkeys(("y", "yyyy", "u", "uuuu"), r"[+-]?\d+"),
           **dict.fromkeys(("M", "MM", "d", "dd", "H", "HH", "h", "hh", "m", "mm", "s", "ss"), r"\d+"),
           **{"S" * n: r"\d+" for n in range(1, 10)}, "MMM": r"\p{L}+\.?"}
_PLAIN = set(" /-:.,T")


def shape_regex(pattern: str) -> str | None:
    """A loose regex that every text the pattern can parse also matches, or None
    for a pattern with any part that is not modelled here (optional sections,
    quotes, eras, zones, ...): such a pattern is tried on every text.

    A failed ``try_to_timestamp`` is costly (the parser raises and catches
    inside), so a modelled pattern is only tried on text of its shape."""
    out = []
    for m in _RUN.finditer(pattern):
        tok = m.group(0)
        if tok in _TOKENS:
            out.append(_TOKENS[tok])
        elif tok in _PLAIN:
            out.append(re.escape(tok))
        else:
            return None
    return "^" + "".join(out) + "$"


def _guarded(c: Column, pattern: str, parsed: Column) -> Column:
    shape = shape_regex(pattern)
    return parsed if shape is None else F.when(c.rlike(shape), parsed)


def parse_ts(col, formats: Sequence[str] = DEFAULT_TS_FORMATS, ntz: bool = False) -> Column:
    """First pattern that parses wins; no match gives NULL, never an error."""
    c = F.trim(_c(col).cast("string"))
    out = F.coalesce(*[_guarded(c, f, F.try_to_timestamp(c, F.lit(f))) for f in formats])
    return out.cast("timestamp_ntz") if ntz else out


def parse_date(col, fmt: str = "yyyyMMdd") -> Column:
    """Fixed-width date text (e.g. mainframe ``OPEN_DT``); bad dates give NULL."""
    c = F.trim(_c(col).cast("string"))
    return _guarded(c, fmt, F.try_to_date(c, fmt))
