"""Bronze ingest (ST1, ST2, ST4, SRC1-SRC4): files -> rows of the declared columns,
``_rescued_data`` and ingest metadata, partitioned by ingest date.

The stream discovers files: its source lists them (the file-source log in the
checkpoint remembers which were seen) and each micro-batch loads its new files as a
batch does, so both give the same columns and rows.  Columns are matched by *name*,
as Spark matches names (an exact match goes first; otherwise letter case counts only with
``spark.sql.caseSensitive``), file by file: files are grouped by layout (``sources.layouts``),
of which there are few, and each group is read with its own schema.  So a
reordered, added or retyped column neither stops the load nor lands in another
column; what the declared columns can't hold is kept as text in ``_rescued_data``, and so are
the parts of nested values that the declared types can't hold.  CSV records may hold
line breaks in quotes.

Each micro-batch is written exactly once (see ``sources.sinks.append_batches``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from strata.sources.files import declare_or_infer_schema
from strata.sources.layouts import Layout, find_layouts
from strata.sources.metadata import with_ingest_metadata
from strata.sources.rescue import RESCUED, named, rescue_columns, rescue_json
from strata.sources.sinks import append_batches

GLOBS = {"csv": "*.csv", "json": "*.json", "parquet": "*.parquet"}


@dataclass
class BronzeConfig:
    source_path: str
    target_path: str
    checkpoint: str
    fmt: str = "csv"                       # csv | json | parquet
    columns: Sequence[str] = ()            # csv header / json keys
    expected: Mapping[str, DataType | str] = field(default_factory=dict)
    schema: StructType | None = None       # parquet (or any format: names and types)
    schema_at: str | None = None           # remember an inferred schema here (SRC6)
    layouts_at: str | None = None          # remember the layouts of files here
    escape: str = "\\"                      # csv: what stands before a quote inside quotes ('"' for doubled quotes)
    partition_by: Sequence[str] = ("_ingest_date",)
    glob: str | None = None
    max_files_per_trigger: int | None = None
    available_now: bool = True             # False: run on until stopped


def declared(spark: SparkSession, cfg: BronzeConfig) -> dict[str, DataType | str]:
    """Name -> type of the columns that bronze has; inferred once and remembered
    where ``schema_at`` names a place and nothing is declared."""
    if cfg.expected:
        return dict(cfg.expected)
    if cfg.columns:
        return {c: "string" for c in cfg.columns}
    schema = cfg.schema
    if schema is None and cfg.schema_at:
        schema = declare_or_infer_schema(spark, cfg.fmt, cfg.source_path, cfg.schema_at, glob=_glob(cfg))
    if schema is None:
        raise ValueError("bronze needs columns, expected types, a schema or a place to remember one")
    return {f.name: f.dataType for f in schema.fields}


def _glob(cfg: BronzeConfig) -> str:
    return cfg.glob or GLOBS[cfg.fmt.lower()]


def _fresh(name: str, taken: Sequence[str]) -> str:
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def match_names(spark: SparkSession, types: Mapping[str, DataType | str], have: Sequence[str]) -> dict[str, int]:
    """Declared name -> place in ``have`` of the column that it stands for."""
    places = {n: have.index(n) for n in types if n in have}
    if spark.conf.get("spark.sql.caseSensitive") != "true":
        taken = set(places.values())
        for n in types:
            at = next((i for i, h in enumerate(have) if h.lower() == n.lower() and i not in taken), None)
            if n not in places and at is not None:
                places[n] = at
                taken.add(at)
    return places


def _declared_rows(raw: DataFrame, types: Mapping[str, DataType | str], places: Mapping[str, int], have: Sequence[str],
                   text: Callable[[int], Column], keep: Sequence[str], corrupt: str | None = None) -> DataFrame:
    """The columns ``types``, ``_rescued_data`` and those in ``keep``.  ``text(i)`` is the text of the column at
    place i of ``have``; columns without a declared name are rescued."""
    extra = [i for i in range(len(have)) if i not in places.values()]
    own, keys = "_other", {}
    while any(f"{own}{i}".lower() in {c.lower() for c in (*types, *keep, corrupt or "")} for i in extra):
        own = f"_{own}"
    for i in extra:
        name = have[i] or f"_c{i}"
        keys[f"{own}{i}"] = f"{name}#{i}" if name in (*types, *keys.values()) else name
    cols = [(text(places[n]) if n in places else F.lit(None).cast("string")).alias(n) for n in types]
    rows = raw.select(*cols, *[text(i).alias(f"{own}{i}") for i in extra], *[named(c) for c in keep], *([named(corrupt)] if corrupt else []))
    return rescue_columns(rows, types, corrupt=corrupt, undeclared=keys)


def _csv_rows(spark: SparkSession, layout: Layout, files: Sequence[str], types: Mapping[str, DataType | str], file: str,
              escape: str) -> DataFrame:
    have = list(layout.header)
    places = match_names(spark, types, have)
    # read by place, so that any names will do
    cells = [f"_c{i}" for i in range(len(have))]
    corrupt = _fresh("_corrupt", [*cells, *have, *types, file])
    schema = StructType([StructField(c, StringType()) for c in (*cells, corrupt)])
    raw = (spark.read.schema(schema).options(header="true", mode="PERMISSIVE", enforceSchema="true", columnNameOfCorruptRecord=corrupt, escape=escape,
                                             multiLine=str(layout.many_lines).lower()).csv(list(files)))
    raw = raw.withColumn(file, F.col("_metadata.file_path"))
    return _declared_rows(raw, types, places, have, lambda i: F.col(cells[i]), [file], corrupt)


def _json_rows(spark: SparkSession, files: Sequence[str], types: Mapping[str, DataType | str], file: str) -> DataFrame:
    value = _fresh("value", [*types, file])
    raw = spark.read.text(list(files)).select(F.col("value").alias(value), F.col("_metadata.file_path").alias(file))
    return rescue_json(raw, types, value)


def _parquet_rows(spark: SparkSession, layout: Layout, files: Sequence[str], types: Mapping[str, DataType | str], file: str,
                  escape: str) -> DataFrame:
    """(``escape`` is for CSV.)  Columns that already have the declared type are read as they are; others go through
    their text (nested ones through JSON), and back where they fit."""
    schema = StructType.fromJson(json.loads(layout.schema))
    have, kinds = schema.fieldNames(), [f.dataType for f in schema.fields]
    places = match_names(spark, types, have)
    same = {n: i for n, i in places.items() if isinstance(types[n], DataType) and types[n].simpleString() == kinds[i].simpleString()}
    asis = {n: f"_same{k}" for k, n in enumerate(same)}
    while {*asis.values()} & {*types, *have, file}:
        asis = {n: f"_{c}" for n, c in asis.items()}
    others = [i for i in range(len(have)) if i not in same.values()]
    raw = spark.read.schema(schema).parquet(*files).select(
        *[named(h) for h in have], *[named(have[i]).alias(asis[n]) for n, i in same.items()], F.col("_metadata.file_path").alias(file))

    def text(k: int) -> Column:
        c, kind = named(have[others[k]]), kinds[others[k]]
        return F.to_json(c) if isinstance(kind, (StructType, MapType, ArrayType)) else c.cast("string")

    rows = _declared_rows(raw, {n: t for n, t in types.items() if n not in same}, {n: others.index(i) for n, i in places.items() if n not in same},
                          [have[i] for i in others], text, [file, *asis.values()])
    return rows.select(*[named(asis.get(n, n)).alias(n) for n in types], RESCUED, named(file))


def bronze_rows(spark: SparkSession, cfg: BronzeConfig, listing: Sequence[Row]) -> DataFrame | None:
    """The bronze rows of listed files (path, length, modificationTime); None for no files."""
    if not listing:
        return None
    fmt, types = cfg.fmt.lower(), declared(spark, cfg)
    if fmt == "json":
        file = _fresh("_file", list(types))
        parts = [_json_rows(spark, sorted(r.path for r in listing), types, file)]
    elif fmt in ("csv", "parquet"):
        read = _csv_rows if fmt == "csv" else _parquet_rows
        layouts = sorted(find_layouts(spark, fmt, listing, cfg.layouts_at, cfg.escape).items())
        file = _fresh("_file", [*types, *(name for layout, _ in layouts for name in layout.names())])
        parts = [read(spark, layout, sorted(files), types, file, cfg.escape) for layout, files in layouts]
    else:
        raise ValueError(f"unsupported bronze format {cfg.fmt!r}")
    if not parts:
        return None
    rows = parts[0].select(*[named(n) for n in types], RESCUED, named(file))
    for p in parts[1:]:
        rows = rows.union(p.select(*[named(n) for n in types], RESCUED, named(file)))
    return with_ingest_metadata(rows, source_file=named(file)).drop(file)


def _discover(reader, cfg: BronzeConfig):
    """Files of the source, by path; their contents are not read."""
    reader = reader.format("binaryFile").option("pathGlobFilter", _glob(cfg))
    if cfg.max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(cfg.max_files_per_trigger))
    return reader


def bronze_batch(spark: SparkSession, cfg: BronzeConfig) -> DataFrame | None:
    """SRC4: all files of the source as one load, with the columns of the stream."""
    found = _discover(spark.read, cfg).load(cfg.source_path).select("path", "length", "modificationTime")
    return bronze_rows(spark, cfg, found.collect())


def bronze_stream(spark: SparkSession, cfg: BronzeConfig, wait: bool = True) -> StreamingQuery:
    """Load the files that are new since the last run of this checkpoint into
    ``cfg.target_path``; or, with ``available_now=False``, go on as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = _discover(spark.readStream.schema(schema), cfg).load(cfg.source_path).select("path", "length", "modificationTime")

    def rows(batch: DataFrame) -> DataFrame | None:
        return bronze_rows(batch.sparkSession, cfg, batch.collect())

    return append_batches(found, cfg.target_path, cfg.checkpoint, rows, cfg.partition_by, cfg.available_now, wait)
