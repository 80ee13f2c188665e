"""Session helpers: a tuned local session for tests/bench, and the shared
scratch folder every job that must cut lineage or stage files uses."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import SparkSession

# Settings a job relies on.  On a cluster these come from the job config;
# ``local_session`` sets them for tests and the bench.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "strata", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench: ``local[cores]``, UI off, UTC."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("STRATA_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def defaults(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """The settings of ``conf`` that the session doesn't have, for the time of the block (a stream keeps those it began with)."""
    unset = [k for k in conf if spark.conf.get(k, None) is None]
    for k in unset:
        spark.conf.set(k, conf[k])
    try:
        yield
    finally:
        for k in unset:
            spark.conf.unset(k)


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the job config names a shared (HDFS / object store)
    folder; it is read from the session and never replaced.  Only when it
    is unset and the master is local (tests, the bench) is a fresh local folder
    created; elsewhere executors would each write to a disk of their own, so
    an unset folder is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        app = sc.applicationId
        root = _LOCAL_ROOTS.get(app)
        if root is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="strata-ckpt-")
            _LOCAL_ROOTS[app] = root
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Shuffle files go with the statement that wrote them.  Else they stay until the driver happens to collect its
#: garbage, which a large table, with few collections for its bytes, does not wait for.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Folders that a task writes to at once: so rows need not be sorted by folder.
WRITERS = {"spark.sql.maxConcurrentOutputFileWriters": "16"}


def materialize(df, name: str = "stage", options: Mapping[str, str] | None = None, partition_by: Sequence[str] = ()):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a frame reading it back: lineage is cut (a lost executor does
    not recompute the upstream) and non-deterministic columns (row ids)
    have one fixed value for every later reader.  ``options``: the writer's.
    ``partition_by``: columns that rows are kept apart by, in folders."""
    path = scratch_path(df.sparkSession, name)
    with defaults(df.sparkSession, {**CLEANUP, **(WRITERS if partition_by else {})}):
        df.write.options(**(options or {})).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if partition_by else df.sparkSession.read.parquet(path)


def discard(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete scratch data that nothing reads any more: a frame that
    :func:`materialize` returned, or a path under the checkpoint folder."""
    if spark is None:
        spark = df_or_path.sparkSession
    paths = [df_or_path] if isinstance(df_or_path, str) else {unquote(f).rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    root = checkpoint_root(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/") + "/"):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
