"""Joins (J1-J5).  Equi-joins only; the physical strategy is Catalyst's.

A side is broadcast explicitly only after its row count has been checked
against a bound.  The check collects ``limit(bound + 1)`` of a constant
column as Arrow: a limit at the root of a plan runs incrementally (one
partition, then 4x more, ...) and stops as soon as ``bound + 1`` rows are
seen, reading no columns, so checking a huge table costs about ``bound``
rows, not a scan of the table (a ``limit().count()`` would run a limit in
*every* partition).  Otherwise the plain join is left
to Catalyst / AQE, which still switch to a broadcast at run time when the
measured shuffle output is small, and otherwise run a sort-merge join
with skew-split enabled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.keys import md5_key

# Default row bound for an explicit broadcast of a dimension (joined
# dimensions are projected to the few columns the join needs first).
BROADCAST_ROWS = 100_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads and returns at
    most ``max_rows + 1`` one-byte rows."""
    probe = df.select(F.lit(True).alias("_")).limit(max_rows + 1)
    return probe.toArrow().num_rows <= max_rows


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                   max_broadcast_rows: int | None = BROADCAST_ROWS) -> DataFrame:
    """Enrich ``fact`` with ``dim``, which is broadcast when it was counted to be
    within the bound and joined without a hint otherwise."""
    if max_broadcast_rows is not None and fits_broadcast(dim, max_broadcast_rows):
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)


def join_nullable(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                  max_broadcast_rows: int | None = BROADCAST_ROWS, spread: int = 1 << 10) -> DataFrame:
    """Left join on a key that many fact rows lack.  A NULL key meets nothing, but
    all such rows would be dealt to one partition; a second key, a hash of the
    row where the key is NULL and 0 elsewhere, spreads them."""
    if max_broadcast_rows is not None and fits_broadcast(dim, max_broadcast_rows):
        return fact.join(F.broadcast(dim), fact[fact_key] == dim[dim_key], "left").drop(dim[dim_key])
    salt = F.when(F.col(fact_key).isNull(), F.pmod(F.xxhash64(*fact.columns), F.lit(spread)) + 1).otherwise(F.lit(0))
    f = fact.withColumn("_salt", salt)
    # not a literal: a constant would fold the second key away
    d = dim.withColumn("_salt_0", F.when(F.col(dim_key).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return (f.join(d, (f[fact_key] == d[dim_key]) & (f["_salt"] == d["_salt_0"]), "left")
             .drop(d[dim_key]).drop("_salt", "_salt_0"))


def lookup_category(items: DataFrame, dim: DataFrame, key: str = "item_id",
                    category: str = "category", default: str = "Unknown",
                    max_broadcast_rows: int | None = BROADCAST_ROWS,
                    dedupe_dim: bool = False) -> DataFrame:
    """Item -> category with a fallback for items the dimension lacks (J2);
    rows without an item are spread, not dealt to one task.

    The dimension key is its primary key (checked by a ``unique`` test), so
    by default the dimension is joined as is: de-duplicating it would cost
    a full shuffle of the dimension on every run.  ``dedupe_dim`` keeps one
    row per key for dimensions that are known to repeat rows."""
    d = dim.select(F.col(key).alias("_dim_key"), category)
    if dedupe_dim:
        d = d.dropDuplicates(["_dim_key"])
    out = join_nullable(items, d, key, "_dim_key", max_broadcast_rows)
    return out.withColumn(category, F.coalesce(F.col(category), F.lit(default)))


def map_codes_join(df: DataFrame, col: str, codes: DataFrame, code_col: str,
                   value_col: str, out: str, default: str | None = None,
                   max_broadcast_rows: int | None = BROADCAST_ROWS) -> DataFrame:
    """Code map held as data (PR5 for large dictionaries)."""
    d = codes.select(F.col(code_col).alias("_code"), F.col(value_col).alias(out))
    j = join_dimension(df, d, df[col] == d["_code"], "left", max_broadcast_rows)
    j = j.drop("_code")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(default))) if default is not None else j


def combine_accounts(df: DataFrame, key: str, type_col: str, value_col: str,
                     types: Sequence[str]) -> DataFrame:
    """One row per ``key`` with a column per account type (J3): a single
    conditional aggregate, not one self-join per type.  ``types`` is given,
    so the pivot needs no extra pass to find the distinct values."""
    aggs = [F.sum(F.when(F.col(type_col) == F.lit(t), F.col(value_col))).alias(t) for t in types]
    return df.groupBy(key).agg(*aggs)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent (J4): a left-anti join, which
    needs no distinct parent keys."""
    p = parent.select(F.col(parent_key).alias("_pk"))
    c = child.where(F.col(child_key).isNotNull())
    return c.join(p, c[child_key] == p["_pk"], "left_anti")


def build_star(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]],
               dedupe_dims: bool = False, keep_natural: bool = False) -> tuple[DataFrame, dict]:
    """Kimball star (J5).  ``dims`` maps a dimension name to
    ``(dimension rows, natural key in the dimension, natural key in the fact)``.

    Each dimension gets ``sk_<name> = md5(trim(natural key))``, a stable key
    that needs no sequence and no global sort; the fact's natural key is
    replaced by that surrogate, computed from the fact itself, so the fact
    needs no join at all to receive it.  Natural keys are primary keys
    (``unique`` test); ``dedupe_dims`` drops repeated dimension rows at the
    cost of a shuffle.  ``keep_natural`` leaves the natural key in the fact, for
    joins, which are cheaper on it than on a 32-character hash.  Returns
    (fact, {name: dimension}).
    """
    out_dims = {}
    f = fact
    for name, (dim, dim_key, fact_key) in dims.items():
        sk = f"sk_{name}"
        d = dim.dropDuplicates([dim_key]) if dedupe_dims else dim
        out_dims[name] = d.withColumn(sk, md5_key(F.col(dim_key)))
        f = f.withColumn(sk, F.when(F.col(fact_key).isNotNull(), md5_key(F.col(fact_key))))
        if not keep_natural:
            f = f.drop(fact_key)
    return f, out_dims
