"""Silver keep-latest over a stream (ST3).

Two ways.  *Ranking*: the stream only appends each micro-batch's rows, conformed and tagged
(``sources.sinks.append_batches``), and a batch job ranks the appended rows into a *new*
folder (``snapshot``).  Another checkpoint appends its rows again, which ranking undoes, as they
are exact copies.

*State*: ``latest_changes`` keeps the latest row of each key in the state store, so that a micro-batch
costs its own keys, not the history; only keys that changed are appended.  The order is
that of ``operators.dedupe.keep_latest``: late rows never replace later ones, and ties are decided
by all columns.  ``current`` is the last change of each key; merging folders of
changes keeps just those, so the table is as large as its keys.  State grows with the keys, so it is kept
on the executors' disks (``STATE``: RocksDB, its memory bounded, compressed; a micro-batch's changes go to the
checkpoint as a log), unless the session names another store.  Shuffle files go with their micro-batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

from strata.operators.dedupe import keep_latest, total_order
from strata.session import CLEANUP, defaults
from strata.sources.sinks import append_batches, publish, read_batches


#: Types of keys that are equal only if they are the same (not -0.0 and 0.0, or texts under a collation).
EXACT = (IntegralType, DateType, TimestampType, TimestampNTZType)

#: How a stream's state is stored, where the session doesn't say so.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # rows of state are wide and full of zeros: small on disk only if compressed in larger blocks than 4 KB
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32",
    # a batch's changes go to the checkpoint, not the files that the store rewrites as it grows
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``keep_latest`` as an aggregate (columns named in ``order`` come first, latest first, NULL last), which a
    stream can hold as state.  The ordering holds every column but maps, so its maximum is the row: only rows with
    maps are held beside it.  Whole-number and time keys are not held again: the group has them."""
    names = [*order, *total_order(df, keys, order)]
    plain = {k: f"__key{i}" for i, k in enumerate(keys) if isinstance(df.schema[k].dataType, EXACT) and k not in names}
    names += [k for k in keys if k not in names and k not in plain]
    struct = lambda columns: F.struct(*[F.col(f"`{c}`") for c in columns])
    whole = not {*df.columns} <= {*names, *plain}
    row = F.max_by(struct(c for c in df.columns if c not in plain), struct(names)) if whole else F.max(struct(names))
    kept = df.groupBy(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]).agg(row.alias("__row"))
    return kept.select(*[F.col(plain[c] if c in plain else f"__row.`{c}`").alias(c) for c in df.columns])


def latest_changes(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
                   compact_after: int | None = 16, **more) -> StreamingQuery:
    """Append to ``target`` each key whose latest row a micro-batch changed, with that row."""
    with defaults(stream.sparkSession, {**STATE, **CLEANUP}):
        return append_batches(latest_rows(stream, keys, order), target, checkpoint, output_mode="update", compact_after=compact_after,
                              merge=lambda rows: keep_latest(rows, keys, order), **more)


def current(spark: SparkSession, target: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key, from the changes alone."""
    return keep_latest(read_batches(spark, target), keys, order)


def publish_current(spark: SparkSession, target: str, name: str, root: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``current`` as a new version of the table ``name``; who has the last version open keeps it."""
    return publish(current(spark, target, keys, order), name, root)


def snapshot(df: DataFrame, root: str) -> DataFrame:
    """``df`` written as a new version under ``root`` and read back.

    Which version readers use is for the caller to publish (its path, or a view or
    catalog table over it); older versions stay until they are deleted."""
    path = f"{root.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.option("basePath", path).parquet(path)
