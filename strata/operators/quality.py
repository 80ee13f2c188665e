"""Data quality: validation split, declarative tests, reconciliation
(PR8, DQ1-DQ7).

Tests are stacked into one result table ``(model, column_name, test,
failures)``; all tests of a model run in one pass over it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, MapType, NumericType, VariantType

from strata.operators.joins import orphans

RESULT_COLUMNS = ("model", "column_name", "test", "failures")


def reject_reasons(required: Sequence[str], rules: Mapping[str, Column] | None = None) -> Column:
    """``;``-joined reasons a row is rejected ('' when it is valid): a NULL
    required column, or a named rule that is not TRUE."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    for name, pred in (rules or {}).items():
        reasons.append(F.when(~F.coalesce(pred, F.lit(False)), F.lit(name)))
    if not reasons:
        return F.lit("")
    return F.array_join(F.array_compact(F.array(*reasons)), ";")


def split_valid(df: DataFrame, required: Sequence[str],
                rules: Mapping[str, Column] | None = None,
                reason_col: str = "_reject_reason") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine).  A row is quarantined when a required column is
    NULL or a named rule is not TRUE; ``reason_col`` lists every reason,
    ``;``-separated.  Both outputs come from one reasons expression."""
    tagged = df.withColumn(reason_col, reject_reasons(required, rules))
    valid = tagged.where(F.col(reason_col) == F.lit("")).drop(reason_col)
    quarantine = tagged.where(F.col(reason_col) != F.lit(""))
    return valid, quarantine


def _row(model: str, column: str, test: str, failures: Column) -> list[Column]:
    return [F.lit(model), F.lit(column), F.lit(test), failures.cast("bigint")]


def _stack(df: DataFrame, rows: list[list[Column]]) -> DataFrame:
    """Turn one aggregate row with k result cells into k result rows."""
    arr = F.array(*[F.struct(*[c.alias(n) for c, n in zip(r, RESULT_COLUMNS)]) for r in rows])
    return df.select(F.inline(arr))


def not_null(df: DataFrame, cols: Iterable[str], model: str = "model") -> DataFrame:
    """DQ1: NULL count per column, all columns in one pass."""
    cols = list(cols)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_nn{i}") for i, c in enumerate(cols)])
    return _stack(agg, [_row(model, c, "not_null", F.col(f"_nn{i}")) for i, c in enumerate(cols)])


def unique(df: DataFrame, col: str, model: str = "model") -> DataFrame:
    """DQ2: number of non-NULL values that occur more than once."""
    return repeated_values(df, col).agg(*_named(_row(model, col, "unique", F.count(F.lit(1)))))


def accepted_values(df: DataFrame, col: str, values: Sequence, model: str = "model") -> DataFrame:
    """DQ3: number of distinct non-NULL values outside ``values``."""
    bad = F.when(~F.col(col).isin(list(values)), F.col(col))
    agg = df.agg(F.count_distinct(bad).alias("_av"))
    return agg.select(*_named(_row(model, col, "accepted_values", F.col("_av"))))


def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str,
                  model: str = "model") -> DataFrame:
    """DQ4: child rows with a non-NULL key missing from the parent."""
    keys = parent.select(parent_key(parent, parent_col, child.schema[col].dataType).alias("_key"))
    o = orphans(child.select(col), keys, col, "_key")
    return o.agg(*_named(_row(model, col, "relationships", F.count(F.lit(1)))))


def repeated_values(df: DataFrame, col: str) -> DataFrame:
    """The non-NULL values that occur more than once, and how often; counted in the tasks first, so a hot value is a row per task."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")


def missing_values(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """The distinct non-NULL keys of ``child`` that ``parent`` lacks, and how often they occur."""
    keys = parent.select(parent_key(parent, parent_col, child.schema[col].dataType).alias("_parent"))
    some = child.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_key")).agg(F.count("*").alias("_n"))
    return some.join(keys, some["_key"] == keys["_parent"], "left_anti")


def parent_key(parent: DataFrame, col: str, child: DataType) -> Column:
    """A parent's key in the child's type; NULL, which matches nothing, where that type can't hold it (a text
    that is no number, a number out of range) or would change it (a fraction)."""
    have = parent.schema[col].dataType
    if have == child:
        return F.col(col)
    key = F.col(col).try_cast(child)
    return F.when(key.try_cast(have) == F.col(col), key) if isinstance(have, NumericType) else key


def _text(value: Column, kind: DataType) -> Column:
    """A value as text, equal for values that are equal (0.0 and -0.0 are)."""
    return ((value + F.lit(0.0)) if isinstance(kind, (DoubleType, FloatType)) else value).cast("string")


def _named(cells: list[Column]) -> list[Column]:
    return [c.alias(n) for c, n in zip(cells, RESULT_COLUMNS)]


@dataclass
class TestSuite:
    """Declarative tests of one model (the dbt-style YAML block as data)."""
    __test__ = False          # not a pytest class
    model: str
    not_null: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    accepted_values: dict[str, list] = field(default_factory=dict)
    relationships: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    docs: dict[str, str] = field(default_factory=dict)


def run_tests(df: DataFrame, suite: TestSuite) -> DataFrame:
    """DQ5: every test of the suite as rows of one table, in one pass over ``df``.

    Each row becomes the values that its tests look at -- NULLs, values outside
    a list, keys that must be unique or have a parent, each with the test's number;
    rows that pass the cheap tests yield nothing.  Those values are counted by
    (test, value), combined before the shuffle, so a hot value is one row per
    task; parents come in as values of their own.  A second, small aggregate
    turns the counts into failures, and tests without any are filled in."""
    tests: list[tuple[str, str]] = []
    cells: list[Column] = []
    parents: list[DataFrame] = []

    def seen(value: Column, keep: Column) -> None:
        i = F.lit(len(tests) - 1)
        cells.append(F.when(keep, F.struct(i.alias("t"), value.alias("v"))))

    for c in suite.not_null:
        tests.append((c, "not_null"))
        seen(F.lit(None).cast("string"), F.col(c).isNull())
    for c, vals in suite.accepted_values.items():
        tests.append((c, "accepted_values"))
        seen(_text(F.col(c), df.schema[c].dataType), ~F.col(c).isin(list(vals)))
    for c in suite.unique:
        tests.append((c, "unique"))
        seen(_text(F.col(c), df.schema[c].dataType), F.col(c).isNotNull())
    for c, (parent, parent_col) in suite.relationships.items():
        tests.append((c, "relationships"))
        seen(_text(F.col(c), df.schema[c].dataType), F.col(c).isNotNull())
        key = _text(parent_key(parent, parent_col, df.schema[c].dataType), df.schema[c].dataType)
        parents.append(parent.select(F.lit(len(tests) - 1).alias("t"), key.alias("v")).where("v is not null")
                       .select("t", "v", F.lit(0).alias("child"), F.lit(1).alias("parent")))
    if not tests:
        raise ValueError("run_tests: empty suite")
    rows = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("x"))
              .select("x.t", "x.v", F.lit(1).alias("child"), F.lit(0).alias("parent")))
    for p in parents:
        rows = rows.union(p)
    values = rows.groupBy("t", "v").agg(F.sum("child").alias("n"), F.max("parent").alias("known"))
    kinds = F.array(*[F.lit(kind) for _, kind in tests])
    kind = kinds[F.col("t")]
    failures = (F.when(kind == "not_null", F.col("n"))
                 .when(kind == "accepted_values", F.lit(1))
                 .when(kind == "unique", F.when(F.col("n") > 1, F.lit(1)))
                 .when(F.col("known") == 0, F.col("n")))
    counted = values.groupBy("t").agg(F.sum(failures).alias("failures"))
    named = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(suite.model).alias("model"), F.lit(c).alias("column_name"),
                               F.lit(k).alias("test")) for i, (c, k) in enumerate(tests)])
    every = df.sparkSession.range(1).select(F.inline(named))
    return every.join(counted, "t", "left").select(
        "model", "column_name", "test", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"))


#: Slots of the filter that finds rows with a failing key, rows beyond which a failing value is hot, and parts that its rows are dealt to.
SLOTS, HOT, PARTS = 1 << 20, 4096, 32


def failing_rows(df: DataFrame, suite: TestSuite) -> DataFrame:
    """DQ5: the rows that break a test of any kind, with the tests, as ``kind:column``, in ``_failed_tests``.

    Row tests are expressions.  For ``unique`` and ``relationships`` the failing *values* are found first,
    by counts combined in the tasks, and led back to their rows in two steps: a filter
    on hash slots, broadcast as bits (SLOTS / 64 rows at most, however many values fail), lets rows
    pass that may hold one, without a shuffle; only those meet the values in a join by shuffle.  Rows and values of a slot with a
    hot value are dealt to PARTS parts, so that a value that a third of the rows hold is in no single task.
    Input columns whose names begin with ``_dq_`` are not supported."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in suite.not_null]
    checks += [F.when(~F.col(c).isin(list(v)), F.lit(f"accepted_values:{c}"))
               for c, v in suite.accepted_values.items()]
    keys = [("unique", c, repeated_values(df, c)) for c in suite.unique]
    keys += [("relationships", c, missing_values(df, c, *p)) for c, p in suite.relationships.items()]
    row = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    rows = df.withColumn("_failed_tests", row)
    slot = lambda key, kind: F.pmod(F.xxhash64(_text(key, kind)), F.lit(SLOTS)).cast("int")
    is_set = lambda bits, s: F.coalesce(F.getbit(F.col(bits), F.col(s).bitwiseAND(F.lit(63))) == 1, F.lit(False))
    maybe, filters = F.size("_failed_tests") > 0, []
    for i, (_, c, bad) in enumerate(keys):
        kind = df.schema[c].dataType
        one = F.expr("shiftleft(1L, s & 63)")
        bits = (bad.select(slot(F.col("_key"), kind).alias("s"), "_n").groupBy(F.shiftright("s", 6).alias(f"_dq_w{i}"))
                   .agg(F.bit_or(one).alias(f"_dq_f{i}"), F.bit_or(F.when(F.col("_n") > HOT, one)).alias(f"_dq_h{i}")))
        filters.append(F.broadcast(bits))
        at = F.when(F.col(c).isNotNull(), slot(F.col(c), kind))
        rows = rows.withColumn(f"_dq_s{i}", at).withColumn(f"_dq_w{i}", F.shiftright(f"_dq_s{i}", 6)).join(filters[i], f"_dq_w{i}", "left")
        maybe = maybe | is_set(f"_dq_f{i}", f"_dq_s{i}")
    rows = rows.where(maybe)
    part = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]), F.lit(PARTS))
    for i, (test, c, bad) in enumerate(keys):
        every = F.when(is_set(f"_dq_h{i}", "s"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
        dealt = (bad.select(F.col("_key").alias(f"_dq_k{i}"), slot(F.col("_key"), df.schema[c].dataType).alias("s"))
                    .withColumn(f"_dq_w{i}", F.shiftright("s", 6)).join(filters[i], f"_dq_w{i}", "left")
                    .select(f"_dq_k{i}", F.explode(every).alias(f"_dq_p{i}")))
        own = F.when(is_set(f"_dq_h{i}", f"_dq_s{i}"), part).otherwise(F.lit(0))
        # both sides grow with the input: by shuffle at every size
        rows = rows.join(dealt.hint("merge"), (F.col(c) == F.col(f"_dq_k{i}")) & (own == F.col(f"_dq_p{i}")), "left").withColumn(
            "_failed_tests", F.when(F.col(f"_dq_k{i}").isNotNull(), F.array_append("_failed_tests", F.lit(f"{test}:{c}"))).otherwise(F.col("_failed_tests")))
    return rows.where(F.size("_failed_tests") > 0).select(*[F.col(f"`{c}`") for c in df.columns], "_failed_tests")


def describe_model(df: DataFrame, docs: Mapping[str, str]) -> DataFrame:
    """DQ6: attach descriptions as column metadata (``comment``), which
    ``saveAsTable`` stores as column comments."""
    out = df
    for c, text in docs.items():
        out = out.withMetadata(c, {**df.schema[c].metadata, "comment": text})
    return out


LAYER = "_layer"


def reconcile(layers: Mapping[str, DataFrame], key: str = "_source_file",
              source: str = "rows_in", outcomes: Sequence[str] | None = None,
              content: Sequence[str] = ()) -> DataFrame:
    """DQ7: lineage as data.  ``layers`` maps an outcome name (e.g.
    ``rows_in``, ``kept``, ``superseded``, ``quarantined``) to the frame
    holding those rows; all carry ``key``.  A frame that has a ``_layer``
    column is labelled per row by it instead (one processed frame can then
    carry several outcomes, computed in a single pass).  One union and ONE
    aggregate (no join between layers): per key the count of every
    outcome, the unexplained difference and a ``balanced`` flag.

    ``content``: columns that all layers hold unchanged (no maps).  Then ``content_balanced``
    says whether the outcomes hold the same rows as the source, each as often, in any
    order: two 64-bit hashes of every row are summed in the same aggregate.  NULL is a value
    of its own; rows of equal count but other content don't balance."""
    names = [n for n in layers if LAYER not in layers[n].columns]
    if source not in names:
        raise ValueError(f"reconcile: {source!r} must be a plain layer")
    outs = list(outcomes) if outcomes is not None else [n for n in names if n != source]
    u = None
    for n, d in layers.items():
        label = F.col(LAYER) if LAYER in d.columns else F.lit(n)
        part = d.select(F.col(key).alias(key), label.alias(LAYER), *_row_hashes(content))
        u = part if u is None else u.unionByName(part)
    sign = F.when(F.col(LAYER) == source, 1).when(F.col(LAYER).isin(outs), -1).otherwise(0)
    net = [F.sum(F.when(sign > 0, F.col(f"_hash{i}")).when(sign < 0, -F.col(f"_hash{i}"))
                 .otherwise(F.lit(0).cast("decimal(28,0)"))).alias(f"_net{i}") for i in (0, 1)] if content else []
    agg = u.groupBy(key).agg(*[F.count_if(F.col(LAYER) == F.lit(n)).alias(n) for n in [source, *outs]], *net)
    diff = F.col(source) - sum((F.col(n) for n in outs), F.lit(0))
    out = agg.withColumn("unexplained", diff).withColumn("balanced", diff == 0)
    if not content:
        return out
    same = (diff == 0) & (F.col("_net0") == 0) & (F.col("_net1") == 0)
    return out.withColumn("content_balanced", same).drop("_net0", "_net1")


def _row_hashes(content: Sequence[str]) -> list[Column]:
    """Two hashes of a row; Spark's skip NULLs, so what is NULL is hashed as well."""
    if not content:
        return []
    values = [x for c in content for x in (F.col(c), F.col(c).isNull())]
    # 28 digits: sums have 38, enough for 10 ** 18 rows of a key
    return [F.xxhash64(F.lit(i), *values).cast("decimal(28,0)").alias(f"_hash{i}") for i in (0, 1)]
