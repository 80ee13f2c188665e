"""Layouts of files (SRC1, SRC2, ST2): which files have the same columns, found by a few
distributed jobs whatever the number of files, and remembered.

*CSV*: one scan gives each file's first line and whether a quote is left open at the end of some
line, that is, whether a record goes on in the next line.  Files with such records are read
record by record (one task a file), all others are split by lines.

*Parquet*: the footers of all files are merged by one job.  Only where that fails, because two
files have one column in two types, is the layout of one file taken and every file
tested by reading it so, in one job; those that can be read are merged, the rest is
treated alike; of a few files each is looked at.  The jobs grow with the number of layouts, not of files, and a batch
without a conflict needs one.

The files' layouts are kept in an append-only table, so that a later load of the same source
looks at new or rewritten files alone.
"""

from __future__ import annotations

import csv
import json
import re
from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.session import defaults


#: A group of so many files or fewer that differ is looked at file by file.
FEW = 8
#: Files up to which a group is listed by the driver.
LISTED = {"spark.sql.sources.parallelPartitionDiscovery.threshold": "1000"}


class Layout(NamedTuple):
    """What files have in common: CSV column names (``many_lines``: a record may span lines), or a Parquet schema as JSON."""

    header: tuple[str, ...] = ()
    many_lines: bool = False
    schema: str = ""

    def names(self) -> list[str]:
        return StructType.fromJson(json.loads(self.schema)).fieldNames() if self.schema else list(self.header)


def csv_layouts(spark: SparkSession, files: Sequence[str], escape: str = "\\") -> dict[Layout, list[str]]:
    escaped = F.replace("value", F.lit(f'{escape}"'), F.lit(""))
    quotes = F.length(escaped) - F.length(F.replace(escaped, F.lit('"'), F.lit("")))
    # blank lines before the header don't count
    lines = spark.read.text(list(files)).where(F.col("value").rlike(r"[^\x00-\x20]")).select(
        F.col("_metadata.file_path").alias("file"), (quotes % 2 == 1).alias("open"),
        # the first line is the first of the file's first block
        F.when(F.col("_metadata.file_block_start") == 0, F.struct(F.monotonically_increasing_id().alias("i"), "value")).alias("line"))
    found = lines.groupBy("file").agg(F.min("line").alias("first"), F.max("open").alias("open")).collect()
    paths = _by_uri(spark, files)
    out: dict[Layout, list[str]] = defaultdict(list)
    for r in found:
        path, line = paths[_full(unquote(r.file))], r["first"].value
        if line.replace(f'{escape}"', "").count('"') % 2:  # the header itself goes on in the next line
            rows = spark.read.options(multiLine="true", escape=escape).csv(path).head(1)
            names = tuple("" if x is None else x for x in rows[0])
        else:
            names = tuple(next(csv.reader([line]), ()))
        out[Layout(header=names, many_lines=r.open)].append(path)
    return out


def _by_uri(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """Paths as given, by their full form (see ``_full``); those without a scheme get that of the default store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def whole(f: str) -> str:
        if re.match("[A-Za-z][A-Za-z0-9+.-]*:", f):
            return f
        p = jvm.org.apache.hadoop.fs.Path(f)
        return p.getFileSystem(conf).makeQualified(p).toString()

    return {_full(whole(f)): f for f in files}


def _full(path: str) -> str:
    """One form for ``file:/x`` and ``file:///x``."""
    return re.sub("^file:/+", "file:/", path)


def merged_schema(spark: SparkSession, files: Sequence[str]) -> StructType | None:
    """The schema that all files can be read with; None if a column has two types."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(*files).schema
    except (AnalysisException, PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
        return None


def readable(spark: SparkSession, files: Sequence[str], schema: StructType) -> list[str]:
    """The files with rows whose columns can all be read with the types of ``schema``.

    Files that can't are passed over by the scan.  A damaged file is passed over too; it matches no
    layout but its own, so reading it fails then."""
    raw = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*files)
    # the sum is asked for, or the scan would read no column
    read = sum((F.count("`" + c.replace("`", "``") + "`") for c in schema.fieldNames()), F.lit(0))
    rows = raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(read.alias("n")).where("n >= 0").select("file").collect()
    have, paths = {_full(unquote(r.file)) for r in rows}, _by_uri(spark, files)  # the metadata column holds a URI
    return [p for uri, p in paths.items() if uri in have]


def parquet_layouts(spark: SparkSession, files: Sequence[str]) -> dict[Layout, list[str]]:
    """(Up to ``LISTED`` files are listed without a job of their own.)"""
    with defaults(spark, LISTED):
        return _grouped(spark, files)


def _grouped(spark: SparkSession, files: Sequence[str]) -> dict[Layout, list[str]]:
    out: dict[Layout, list[str]] = defaultdict(list)
    todo = [list(files)] if files else []
    while todo:
        group = todo.pop()
        schema = merged_schema(spark, group)
        if schema is not None:
            out[Layout(schema=schema.json())] += group
            continue
        if len(group) <= FEW:
            for f in group:
                out[Layout(schema=spark.read.parquet(f).schema.json())].append(f)
            continue
        alike = _alike(spark, group)
        if alike:
            todo += [[f for f in group if f not in alike], [f for f in group if f in alike]]
        else:
            todo += [group[len(group) // 2:], group[:len(group) // 2]]
    return out


def _alike(spark: SparkSession, group: Sequence[str]) -> set[str]:
    """Some of the files, by being readable as one of them is; none if no file that is tried tells them
    apart (they differ in columns that it lacks, it has no rows, or they hold lists or structs for its values,
    which stops a read), so that the group is to be halved: files that differ are rare then."""
    tried = []
    for at in sorted({0, len(group) // 3, len(group) // 2, len(group) - 1}):
        try:
            schema = spark.read.parquet(group[at]).schema
            if schema in tried:
                continue
            tried.append(schema)
            alike = {group[at], *readable(spark, group, schema)}
        except (AnalysisException, PySparkException, Py4JJavaError) as e:
            if "FAILED_READ_FILE" not in str(e) and "Invalid Spark read type" not in str(e):
                raise  # a file that can't be read at all stops the merge of its footer, too
            continue
        if 1 < len(alike) < len(group):
            return alike
    return set()


def find_layouts(spark: SparkSession, fmt: str, listing: Sequence[Row], at: str | None = None,
                 escape: str = "\\") -> dict[Layout, list[str]]:
    """Layouts of listed files (path, length, modificationTime); those in the table ``at`` are taken from
    there if the file has not changed since, the others are added to it."""
    known: dict[str, Layout] = {}
    if at:
        stored = _stored(spark, at)
        if stored is not None:
            now = spark.createDataFrame([(r.path, r.length, r.modificationTime) for r in listing], "path string, length long, modified timestamp")
            rows = stored.join(now, ["path", "length", "modified"]).select("path", "layout").collect()
            known = {r.path: _from_json(r.layout) for r in rows}
    new = [r for r in listing if r.path not in known]
    out: dict[Layout, list[str]] = defaultdict(list)
    for path, layout in known.items():
        out[layout].append(path)
    if new:
        paths = [r.path for r in new]
        found = csv_layouts(spark, paths, escape) if fmt == "csv" else parquet_layouts(spark, paths)
        for layout, paths in found.items():
            out[layout] += paths
        if at:
            of = {p: layout for layout, paths in found.items() for p in paths}
            rows = [(r.path, r.length, r.modificationTime, json.dumps(of[r.path])) for r in new if r.path in of]
            spark.createDataFrame(rows, "path string, length long, modified timestamp, layout string").coalesce(1).write.mode("append").parquet(at)
    return out


def _from_json(text: str) -> Layout:
    header, many_lines, schema = json.loads(text)
    return Layout(tuple(header), many_lines, schema)


def _stored(spark: SparkSession, at: str) -> DataFrame | None:
    try:
        return spark.read.schema("path string, length long, modified timestamp, layout string").parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
