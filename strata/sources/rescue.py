"""Rescue mode (SRC7, ST4): a value that does not fit its expected type,
an unexpected field, or a malformed record never fails the load.  The
typed column gets NULL and the original text is kept in
``_rescued_data``:

* field misfits / unknown fields -> a JSON object ``{"field": "text"}``; in a declared struct,
  array or map the part that does not fit, under its path (see ``sources.nested``);
* a malformed record (unparseable JSON, wrong CSV token count) -> the raw
  record text itself.

Expected types are given as ``{name: spec}`` where spec is a Spark type
(or DDL string such as ``"int"`` / ``"decimal(18,2)"`` / ``"struct<a:int>"``), ``"timestamp"``
(tolerant multi-format parse), ``"timestamp:<fmt>|<fmt>"`` or
``"date:<fmt>"``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StringType

from strata.functions.dates import DEFAULT_TS_FORMATS, parse_date, parse_ts
from strata.sources import nested as N

RESCUED = "_rescued_data"
CORRUPT = "_corrupt_record"


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def converter(spec: DataType | str) -> Callable[[Column], Column]:
    """Text -> typed value; NULL when the text does not fit."""
    if isinstance(spec, str):
        s = spec.strip()
        low = s.lower()
        if low == "timestamp":
            return lambda c: parse_ts(c, DEFAULT_TS_FORMATS)
        if low.startswith("timestamp:"):
            fmts = tuple(s.split(":", 1)[1].split("|"))
            return lambda c: parse_ts(c, fmts)
        if low.startswith("date:"):
            fmt = s.split(":", 1)[1]
            return lambda c: parse_date(c, fmt)
        if low in ("string", "varchar"):
            return lambda c: c.cast("string")
        return _exact(s)
    if isinstance(spec, StringType):
        return lambda c: c.cast("string")
    return _exact(spec)


def _exact(spec: DataType | str) -> Callable[[Column], Column]:
    """Cast that does not fit when a decimal type would round the text."""
    if not (isinstance(spec, DecimalType) or str(spec).lower().startswith(("decimal", "numeric"))):
        return lambda c: F.trim(c.cast("string")).try_cast(spec)

    def cast(c: Column) -> Column:
        text = F.trim(c.cast("string"))
        value, wide = text.try_cast(spec), text.try_cast("decimal(38,18)")
        return F.when(wide.isNull() | (wide == value), value)

    return cast


def _merge(old: Column, new: Column) -> Column:
    """Combine an existing rescue value with new misfits (new keys win)."""
    om = F.from_json(old, "map<string,string>")
    nm = F.from_json(new, "map<string,string>")
    kept = F.map_filter(om, lambda k, v: ~F.array_contains(F.map_keys(nm), k))
    merged = F.to_json(F.map_concat(kept, nm))
    return (F.when(old.isNull(), new)
             .when(new.isNull(), old)
             .when(om.isNull(), old)       # old is a raw malformed record: keep it whole
             .otherwise(merged))


def rescue_columns(df: DataFrame, expected: Mapping[str, DataType | str],
                   rescued: str = RESCUED, corrupt: str | None = CORRUPT,
                   undeclared: Sequence[str] | Mapping[str, str] = ()) -> DataFrame:
    """Cast text columns to their expected types, keeping every misfit, and the text
    of every column in ``undeclared`` (names, or the key to keep each under), which is then dropped.

    Columns not in ``expected`` pass through unchanged.  If a corrupt-record
    column is present (CSV ``columnNameOfCorruptRecord``) it wins: the whole
    raw line is the rescue value, and the column is dropped.

    A column with a nested type holds JSON text, parsed once as VARIANT.

    Plan shape: typed values are computed once in their own projection and
    the misfit test reads them back (Catalyst does not collapse a projection
    that would repeat a costly expression); the JSON is ``to_json`` of a
    struct whose NULL fields are omitted, so no higher-order function
    leaves whole-stage codegen but for nested types.
    """
    others = dict(undeclared) if isinstance(undeclared, Mapping) else {n: n for n in undeclared}
    names = [n for n in expected if n in df.columns]
    deep = {n: t for n in names if (t := N.nested_type(expected[n])) is not None}
    tmp = {n: f"__typed_{i}" for i, n in enumerate(names)}
    staged = df.withColumns({tmp[n]: F.try_parse_json(named(n).cast("string")) if n in deep else converter(expected[n])(named(n))
                             for n in names})
    fits = {n: f"__fitted_{i}" for i, n in enumerate(deep)}
    staged = staged.withColumns({c: N.fitted(F.col(tmp[n]), deep[n], converter, N.root(n), F.lit(n)) for n, c in fits.items()})
    if names or others:
        mis = F.struct(*[F.when(named(n).isNotNull() & F.col(tmp[n]).isNull(),
                                named(n).cast("string")).alias(n) for n in names],
                       *[named(n).cast("string").alias(key) for n, key in others.items()])
        js = F.to_json(mis)
        new = F.when(js != F.lit("{}"), js)
    else:
        new = F.lit(None).cast("string")
    if deep:
        inside = F.concat(*[F.col(c)["misfits"] for c in fits.values()])
        new = N.join_objects(new, N.entries_json(inside))
    if corrupt and corrupt in df.columns:
        new = F.coalesce(named(corrupt), new)
    if rescued in df.columns:
        new = _merge(named(rescued), new)
    typed = {n: F.col(fits[n])["value"] if n in deep else F.col(tmp[n]) for n in names}
    out = staged.withColumns({**typed, rescued: new})
    gone = {*tmp.values(), *fits.values(), *others, *([corrupt] if corrupt else [])}
    return out.select(*[named(c) for c in out.columns if c not in gone])


def rescue_json(df: DataFrame, expected: Mapping[str, DataType | str], value: str = "value",
                rescued: str = RESCUED, keep_value: bool = False) -> DataFrame:
    """JSON text column -> expected typed columns + ``_rescued_data``.

    The record is parsed as ``map<string,string>``: unknown keys and nested
    objects survive as text (a ``from_json`` with a struct schema would drop
    unknown keys silently).  Unparseable text -> NULL fields, raw text rescued.
    """
    parsed, variant, fits = "__parsed", "__variant", {}
    deep = {n: t for n, spec in expected.items() if (t := N.nested_type(spec)) is not None}
    df = df.withColumn(parsed, F.from_json(named(value), "map<string,string>"))  # once per record
    if deep:
        df = df.withColumn(variant, F.try_parse_json(named(value)))
        fits = {n: f"__fitted_{i}" for i, n in enumerate(deep)}
        df = df.withColumns({c: N.fitted(N.field(F.col(variant), n), deep[n], converter, N.root(n), F.lit(n)) for n, c in fits.items()})
    m, whole = F.col(parsed), F.col(variant)
    names = list(expected)
    typed = {n: F.col(fits[n])["value"] if n in deep else converter(t)(F.try_element_at(m, F.lit(n)))
             for n, t in expected.items()}

    def misfit(k, v):
        bad = F.lit(True)                       # unknown key -> rescued
        chain = None
        for n, t in expected.items():
            # nested values are looked at below, unless the record can't be parsed (a name repeated inside)
            test = v.isNotNull() & (whole.isNull() if n in deep else converter(t)(v).isNull())
            chain = F.when(k == F.lit(n), test) if chain is None else chain.when(k == F.lit(n), test)
        return chain.otherwise(bad) if chain is not None else bad

    mis = F.map_filter(m, misfit)
    found = F.when(F.size(mis) > 0, F.to_json(mis))
    if deep:
        inside = F.concat(*[F.col(c)["misfits"] for c in fits.values()])
        found = N.join_objects(found, N.entries_json(inside))
    # a repeated key: lookups see only one value; keep the whole record instead
    repeated = F.size(F.map_keys(m)) > F.size(F.array_distinct(F.map_keys(m)))
    res = (F.when(m.isNull() & named(value).isNotNull(), named(value))
            .when(repeated, named(value))
            .otherwise(found))
    cols = [c for c in df.columns if c not in (parsed, variant, *fits.values()) and (keep_value or c != value)]
    return df.select(*[named(c) for c in cols], *[typed[n].alias(n) for n in names], res.alias(rescued))
