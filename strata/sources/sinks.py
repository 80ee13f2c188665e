"""Sinks (SRC9, SRC10, SRC12, SRC13).  ``fmt`` defaults to Parquet; any
format on the classpath (e.g. a table format) can be named instead."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strata.session import CLEANUP, defaults

LOAD = "_load"
#: Folders whose names begin with an underscore and hold no "=" are not read by Spark.
ASIDE, REPLACES = "_aside", "_replaces"


def _fs(spark: SparkSession, path: str):
    """(file system, Path class) of a place."""
    cls = spark._jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark._jsc.hadoopConfiguration()), cls


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders under ``path`` that begin with ``prefix``."""
    fs, cls = _fs(spark, path)
    if not fs.exists(cls(path)):
        return []
    return sorted(n for f in fs.listStatus(cls(path)) if f.isDirectory() and (n := f.getPath().getName()).startswith(prefix))


def _write_once(df: DataFrame, path: str, name: str, fmt: str, partition_by: Sequence[str], replaces: Sequence[str] = ()) -> None:
    """``df`` as folder ``name`` under ``path``: written aside and moved there whole.  A folder that is there
    stays: it holds the same batch, and readers may have it open.  The move is one step on a file system
    that renames folders in one step (HDFS, local disks)."""
    spark = df.sparkSession
    fs, cls = _fs(spark, path)
    if fs.exists(cls(f"{path}/{name}")):
        return
    aside = f"{path}/{ASIDE}/{uuid.uuid4().hex}"
    w = df.write.format(fmt).option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with defaults(spark, CLEANUP):
        w.save(aside)
    if replaces:
        spark.createDataFrame([(r,) for r in replaces], "value string").coalesce(1).write.text(f"{aside}/{REPLACES}")
    if not fs.rename(cls(aside), cls(f"{path}/{name}")):
        raise OSError(f"could not move {aside} to {path}/{name}")


def append_batches(stream: DataFrame, target: str, checkpoint: str,
                   rows: Callable[[DataFrame], DataFrame | None] | None = None,
                   partition_by: Sequence[str] = (), available_now: bool = True,
                   wait: bool = True, fmt: str = "parquet", output_mode: str = "append",
                   compact_after: int | None = None, merge: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """SRC10: append what ``rows`` makes of each micro-batch to ``target``, exactly once.

    ``target`` is a path, or the name of a catalog table, whose rows then lie in a folder of that name
    under the warehouse; the name becomes a view that is moved on after each batch (:func:`publish_batches`).

    A batch has a folder of its own, named by the query's id (which its checkpoint
    keeps) and the batch's number.  It is written aside and moved there whole; a batch replayed after a
    failure finds its folder and leaves it, so it counts once and readers miss
    nothing.  A query with another checkpoint never meets it (the
    log of Spark's file sink, kept by number alone, would skip its first batches).
    ``compact_after``: merge folders as soon as there are more than so many of a size (see :func:`compact_batches`).
    With ``available_now=False`` the query runs on until it is stopped."""
    path = batches_path(stream.sparkSession, target)

    def load(batch: DataFrame, number: int) -> None:
        out = rows(batch) if rows else batch
        if out is None:
            return
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        _write_once(out, path, f"{LOAD}={query}-{number}", fmt, partition_by)
        if compact_after:
            compact_batches(spark, path, compact_after, fmt, partition_by, merge)
        if path != target:
            publish_batches(spark, target, path, fmt)

    w = stream.writeStream.outputMode(output_mode).foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    q = w.start()
    if wait and available_now:
        q.awaitTermination()
    return q


def batches_path(spark: SparkSession, target: str) -> str:
    """Where the rows of an appended table are: ``target`` itself if it is a path."""
    if "/" in target:
        return target.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{target}"


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of batches that count: all but those which a merged folder replaces."""
    found = _folders(spark, path, f"{LOAD}=")
    merged = [f"{path}/{n}/{REPLACES}" for n in found if n.startswith(f"{LOAD}=merged")]
    gone = {r.value for r in spark.read.text(merged).collect()} if merged else set()
    return [n for n in found if n not in gone]


def _level(name: str) -> int:
    """0 for the folder of a batch; for a merged one, how often its rows were merged."""
    m = re.match(rf"{LOAD}=merged(\d+)-", name)
    return int(m[1]) if m else 0


def compact_batches(spark: SparkSession, path: str, least: int = 16, fmt: str = "parquet", partition_by: Sequence[str] = (),
                    merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Merge the folders of a size once there are more than ``least`` of them, into one of the next size,
    so that n batches leave a number of folders that grows with log n, and each row is written log n times.

    Readers see the old folders or the merged one: it replaces them in the one move that
    brings it there.  The old ones are deleted when the next size is merged, or the same again.
    The newest batch of each query is left alone, for a replay to find.  ``merge``
    changes the rows on the way (keep-latest, say); it must not matter how often it is applied."""
    names = committed(spark, path)
    newest: dict[str, str] = {}
    for n in names:
        if _level(n) == 0:
            query, _, number = n.removeprefix(f"{LOAD}=").rpartition("-")
            newest[query] = max(newest.get(query, n), n, key=lambda x: int(x.rpartition("-")[2]))
    for level in range(max(map(_level, names), default=0) + 1):
        group = [n for n in committed(spark, path) if _level(n) == level and n not in newest.values()]
        if len(group) <= least:
            continue
        before = [n for n in _folders(spark, path, f"{LOAD}=") if n not in committed(spark, path)]
        part = _read(spark, path, group, fmt)
        _write_once(merge(part) if merge else part, path, f"{LOAD}=merged{level + 1}-{uuid.uuid4().hex}", fmt, partition_by,
                    [*group, *_replaced(spark, path, group)])
        fs, cls = _fs(spark, path)
        for n in before:  # replaced before this merge
            fs.delete(cls(f"{path}/{n}"), True)


def _replaced(spark: SparkSession, path: str, names: Sequence[str]) -> list[str]:
    """What merged folders among ``names`` replaced, as far as it is still there."""
    merged = [f"{path}/{n}/{REPLACES}" for n in names if _level(n)]
    there = set(_folders(spark, path, f"{LOAD}="))
    return [r.value for r in spark.read.text(merged).collect() if r.value in there] if merged else []


def _read(spark: SparkSession, path: str, names: Sequence[str], fmt: str) -> DataFrame:
    return spark.read.format(fmt).option("basePath", path).load([f"{path}/{n}" for n in names]).drop(LOAD)


def read_batches(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """All rows that :func:`append_batches` wrote to ``target``: one state of it, whatever is appended or merged meanwhile."""
    path = batches_path(spark, target)
    return _read(spark, path, committed(spark, path), fmt)


def publish_batches(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> None:
    """Point the view ``name`` at the folders that count now."""
    names = ",".join(committed(spark, path))
    columns = ", ".join(f"`{c}`" for c in _read(spark, path, committed(spark, path), fmt).columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM {fmt}.`{path}/{{{names}}}`")


def publish(df: DataFrame, name: str, root: str, fmt: str = "parquet", partition_by: Sequence[str] = (), keep: int = 2) -> DataFrame:
    """SRC12 / SRC13 for tables that are read meanwhile: ``df`` as a new version under ``root``, which the view
    ``name`` is then moved to in one step of the catalog.  A reader that has the table open keeps its
    version; the last ``keep`` versions stay, older ones are deleted.  Returns the table."""
    spark = df.sparkSession
    old = _folders(spark, root, "version=")
    number = int(old[-1].removeprefix("version=")) + 1 if old else 1
    version = f"version={number:010d}"
    _write_once(df, root.rstrip("/"), version, fmt, partition_by)
    columns = ", ".join("`" + c.replace("`", "``") + "`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM {fmt}.`{root.rstrip('/')}/{version}`")
    fs, cls = _fs(spark, root)
    for n in [*old, version][:-keep]:
        fs.delete(cls(f"{root.rstrip('/')}/{n}"), True)
    return spark.table(name)


def write_overwrite(df: DataFrame, target: str, fmt: str = "parquet",
                    partition_by: Sequence[str] = (),
                    bucket_by: tuple[int, Sequence[str]] | None = None) -> None:
    """SRC12: full overwrite; the new schema replaces the old one, and so do the
    new partitions all old ones, whatever the session's overwrite mode.

    ``bucket_by=(n, keys)`` (catalog tables only) stores the table hashed
    into ``n`` buckets by ``keys`` and sorted within them: later joins and
    aggregations of two tables bucketed alike on the key read co-located
    buckets and need no shuffle."""
    w = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by is not None:
        if "/" in target:
            raise ValueError("bucket_by needs a catalog table name, not a path")
        n, keys = bucket_by
        w = w.bucketBy(n, *keys).sortBy(*keys)
    if "/" in target:
        w.save(target)
    else:
        w.saveAsTable(target)


def materialize_gold(df: DataFrame, name: str, fmt: str = "parquet",
                     view_only: bool = False) -> DataFrame:
    """SRC13: gold model as a physical table (or a temp view for chaining);
    returns the frame that reads it back, so later models reference the
    stored result instead of recomputing the lineage."""
    spark = df.sparkSession
    if view_only:
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if "/" in name:
        df.write.format(fmt).mode("overwrite").save(name)
        return spark.read.format(fmt).load(name)
    df.write.format(fmt).mode("overwrite").saveAsTable(name)
    return spark.table(name)
