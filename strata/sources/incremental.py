"""Daily gold tables kept up to date by the days that changed (G1, G2, W2, W3, SRC9).

A table holds one row per day (and further keys) with its measures and a rolling
average, partitioned by month.  A refresh recomputes the measures of touched days
only, from the silver rows of those days, and the rolling averages of the rows whose
frame reaches a touched day; months that hold such rows are overwritten, others are
not written.  Silver is read between the first and the last touched day only.

Defined results: rows without a day belong to no row of the table; a NULL in a further
key is a key of its own; a day that lost its last row leaves the table (a row with
``_rows`` 0 stands for it, which :func:`read_daily` leaves out); no touched days, no
write.  Refreshing twice with the same keys gives the same table, so a refresh that
was ended may simply be run again; to let readers see whole versions only, hand
:func:`read_daily` to ``publish``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators.windows import rolling_days, rolling_rows
from strata.session import discard, materialize

MONTH = "_month"


@dataclass(frozen=True)
class DailyTable:
    """``measures`` turns rows with ``day`` and ``keys`` into one row for each of these; ``out`` is the
    average of ``value`` over ``n`` rows (W2) or ``n`` calendar days (W3)."""

    path: str
    measures: Callable[[DataFrame], DataFrame]
    value: str
    out: str
    day: str = "transaction_date"
    keys: tuple[str, ...] = ()
    window: str = "rows"
    n: int = 7

    def __post_init__(self):
        if self.window not in ("rows", "days"):
            raise ValueError(f"window must be 'rows' or 'days', not {self.window!r}")

    @property
    def names(self) -> list[str]:
        return [self.day, *self.keys]


def touched(gold: DailyTable, *changes: DataFrame) -> DataFrame:
    """Days (and further keys) of changed rows: of the new ones, and of those that they replace."""
    out = None
    for rows in changes:
        part = rows.select(*gold.names).where(F.col(gold.day).isNotNull())
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _rolled(gold: DailyTable, daily: DataFrame, out: str) -> DataFrame:
    rolling = rolling_rows if gold.window == "rows" else rolling_days
    return rolling(daily, gold.value, gold.day, gold.n, partition_by=gold.keys, out=out)


def _write(gold: DailyTable, rows: DataFrame, mode: str) -> None:
    # a month is one file, or more where it is large
    (rows.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", mode)
     .partitionBy(MONTH).parquet(gold.path))


def _with_month(gold: DailyTable, rows: DataFrame) -> DataFrame:
    return rows.withColumn(MONTH, F.date_format(gold.day, "yyyy-MM"))


def build(gold: DailyTable, rows: DataFrame) -> None:
    """The whole table from all silver rows."""
    daily = _rolled(gold, gold.measures(rows.where(F.col(gold.day).isNotNull())), gold.out)
    _write(gold, _with_month(gold, daily.withColumn("_rows", F.lit(1))), "static")


def _stored(gold: DailyTable, spark: SparkSession) -> DataFrame:
    # months are text, not whatever they look like
    return spark.read.parquet(gold.path).withColumn(MONTH, F.col(MONTH).cast("string")).where("_rows > 0")


def read_daily(gold: DailyTable, spark: SparkSession) -> DataFrame:
    return _stored(gold, spark).drop("_rows", MONTH)


def _alike(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """``left`` with or without the keys of ``right``; NULL keys are alike."""
    other = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(names)])
    on = [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(names)]
    return left.join(other, on, how)


def _reached(gold: DailyTable) -> tuple[Column, Column]:
    """Place of a row among its key's rows, and of the last touched one up to it."""
    w = Window.partitionBy(*gold.keys).orderBy(gold.day).rowsBetween(Window.unboundedPreceding, 0)
    place = F.sum("_rows").over(w) if gold.window == "rows" else F.unix_date(gold.day)
    return place, F.max(F.when(F.col("_hit"), F.col("_place"))).over(w)


def refresh(gold: DailyTable, rows: DataFrame, keys: DataFrame) -> None:
    """Bring the table up to date with ``rows`` (all current silver rows), of which those of
    ``keys`` (see :func:`touched`) changed."""
    spark = rows.sparkSession
    keys = materialize(keys.select(*gold.names).where(F.col(gold.day).isNotNull()).distinct(), "touched")
    first, last = keys.agg(F.min(gold.day), F.max(gold.day)).first()
    if first is not None:
        near = rows.where(F.col(gold.day).between(F.lit(first), F.lit(last)))
        fresh = materialize(gold.measures(_alike(near, keys, gold.names, "left_semi")), "fresh")
        stored = _stored(gold, spark)
        if gold.window == "days":  # earlier months are in no frame of a row that changes
            since = F.date_format(F.date_sub(F.lit(first), gold.n - 1), "yyyy-MM")
            stored = stored.where(F.col(MONTH) >= since)
        kept = _alike(stored.drop(MONTH), keys, gold.names, "left_anti").withColumn("_hit", F.lit(False))
        hit = F.lit(True).alias("_hit")
        new = fresh.select("*", F.lit(1).alias("_rows"), hit)
        lost = _alike(keys, fresh, gold.names, "left_anti").select("*", F.lit(0).alias("_rows"), hit)
        place, touch = _reached(gold)
        every = (kept.unionByName(new, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
                 .withColumn("_place", place).withColumn("_touch", touch)
                 .withColumn("_hit", F.col("_hit") | F.coalesce(F.col("_place") - F.col("_touch") < gold.n, F.lit(False))))
        every = materialize(_with_month(gold, every.drop("_place", "_touch")), "merged")
        real = _rolled(gold, every.where("_rows > 0"), "_new")
        real = real.withColumn(gold.out, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(gold.out))).drop("_new")
        months = every.where("_hit").select(MONTH).distinct()
        out = real.unionByName(every.where("_rows = 0")).join(F.broadcast(months), MONTH, "left_semi")
        _write(gold, out.drop("_hit"), "dynamic")
        for table in (fresh, every):
            discard(table)
    discard(keys)
