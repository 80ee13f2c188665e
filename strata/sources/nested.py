r"""Nested values in rescue mode (SRC7, SRC3, ST4): a value, as VARIANT, is fitted to a declared
struct, array or map, level by level.

What fits is typed; every part that doesn't is NULL there and kept as text under its
path: ``$.items[2].qty`` for a leaf that is no number, ``$.address.zip4`` for a field that is not
declared, ``$.address`` for a list where a struct is declared.  A column whose whole value
is of another kind is kept under its own name.  Names in a path that are no plain
identifiers stand in ``["..."]``.  Names are matched exactly.

A JSON null and an absent field are NULL and no misfit.  Numbers are kept as VARIANT prints
them (``1.50`` is ``1.5``); a string is taken for a number where a number is declared, as
for columns that aren't nested.  A declared map has string keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

ENTRIES = "array<struct<path:string,text:string>>"


def nested_type(spec: DataType | str) -> DataType | None:
    """The declared type if it is a struct, an array or a map (or VARIANT, which takes anything)."""
    if isinstance(spec, str):
        if not spec.strip().lower().startswith(("struct<", "array<", "map<", "variant")):
            return None
        spec = DataType.fromDDL(spec)
    if isinstance(spec, MapType) and not isinstance(spec.keyType, StringType):
        raise ValueError(f"a nested map needs string keys: {spec.simpleString()}")
    return spec if isinstance(spec, (StructType, ArrayType, MapType, VariantType)) else None


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def field(v: Column, name: str) -> Column:
    """A field of an object; NULL where there is none."""
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))


def _step(name: Column) -> Column:
    """How a name continues a path."""
    plain = F.concat(F.lit("."), name)
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), plain).otherwise(
        F.concat(F.lit('["'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"]')))


def root(name: str) -> Column:
    return F.concat(F.lit("$"), _step(F.lit(name)))


def fitted(v: Column, t: DataType, leaf: Callable[[DataType], Callable[[Column], Column]], path: Column,
           label: Column | None = None) -> Column:
    """struct<value, misfits>: a VARIANT as the declared type, NULL wherever it does not fit, and (path, text)
    of every part left out.  ``leaf`` gives a type's conversion from text; ``label`` is the whole value's path, if another."""
    none = F.array().cast(ENTRIES)
    pair = lambda value, left: F.struct(value.alias("value"), left.alias("misfits"))
    if isinstance(t, VariantType):
        return pair(v, none)
    there = v.isNotNull() & ~F.is_variant_null(v)
    here = F.array(F.struct((path if label is None else label).alias("path"), text_of(v).alias("text")))
    unless = lambda fits, inside: F.when(there & ~fits, here).when(there, inside).otherwise(none)

    def of_struct(m: Column) -> Column:
        known = F.array(*[F.lit(f.name) for f in t.fields]).cast("array<string>")
        others = F.map_entries(F.map_filter(m, lambda k, _: ~F.array_contains(known, k)))
        extra = F.transform(others, lambda e: F.struct(F.concat(path, _step(e["key"])).alias("path"), text_of(e["value"]).alias("text")))
        part = lambda f: _let(F.try_element_at(m, F.lit(f.name)), lambda x: fitted(
            x, f.dataType, leaf, F.concat(path, _step(F.lit(f.name)))))
        each = F.struct(*[part(f).alias(f"f{i}") for i, f in enumerate(t.fields)])

        def joined(r: Column) -> Column:
            value = F.when(m.isNotNull(), F.struct(*[r[f"f{i}"]["value"].alias(f.name) for i, f in enumerate(t.fields)]))
            return pair(value, unless(m.isNotNull(), F.concat(*[r[f"f{i}"]["misfits"] for i in range(len(t.fields))], extra)))

        return _let(each, joined)

    def of_list(a: Column) -> Column:
        each = F.transform(a, lambda x, i: fitted(x, t.elementType, leaf, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return _let(each, lambda r: pair(F.transform(r, lambda x: x["value"]), unless(a.isNotNull(), F.flatten(F.transform(r, lambda x: x["misfits"])))))

    def of_map(m: Column) -> Column:
        each = F.transform_values(m, lambda k, x: fitted(x, t.valueType, leaf, F.concat(path, _step(k))))
        return _let(each, lambda r: pair(F.transform_values(r, lambda _, x: x["value"]),
                                         unless(m.isNotNull(), F.flatten(F.transform(F.map_values(r), lambda x: x["misfits"])))))

    if isinstance(t, StructType):
        return _let(F.try_variant_get(v, "$", "map<string,variant>"), of_struct)
    if isinstance(t, ArrayType):
        return _let(F.try_variant_get(v, "$", "array<variant>"), of_list)
    if isinstance(t, MapType):
        return _let(F.try_variant_get(v, "$", "map<string,variant>"), of_map)
    return _let(leaf(t)(text_of(v)), lambda x: pair(x, unless(x.isNotNull(), none)))


def join_objects(a: Column, b: Column) -> Column:
    """Two texts of JSON objects, each with a field at least or NULL, as one."""
    both = F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit(","), F.substring(b, F.lit(2), F.length(b)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def entries_json(entries: Column) -> Column:
    """(path, text) pairs as a JSON object; NULL if there are none."""
    return F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(entries)))
