"""Schemas and table sources (SRC6, SRC11, SRC14); files are loaded by
``strata.streaming.bronze``, as a batch or as a stream (SRC1-SRC5)."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def declare_or_infer_schema(spark: SparkSession, fmt: str, path: str, stored_at: str,
                            glob: str | None = None) -> StructType:
    """SRC6: infer the schema once, from all the data, store it as JSON at
    ``stored_at``, and reuse the stored one on every later run (so a restart
    reads with the same schema; drift goes to the rescue column).  A schema
    without a column is an error and is never stored.

    CSV is declared all-string from its header: types are applied later
    by ``rescue_columns``, so nothing fails while reading.
    """
    stored = _read_stored_schema(spark, stored_at)
    if stored is not None:
        return stored
    fmt = fmt.lower()
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        names = reader.option("header", "true").csv(path).schema.fieldNames()
        schema = StructType([StructField(c, StringType()) for c in names])
    elif fmt == "json":
        schema = reader.option("samplingRatio", "1.0").json(path).schema
        schema = StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    else:
        schema = reader.option("mergeSchema", "true").format(fmt).load(path).schema
    if not schema.fields:
        raise ValueError(f"no columns found in {path}: declare the schema")
    spark.createDataFrame([(schema.json(),)], "s string").coalesce(1).write.mode("overwrite").text(stored_at)
    return schema


def _read_stored_schema(spark: SparkSession, stored_at: str) -> StructType | None:
    try:
        rows = spark.read.text(stored_at, wholetext=True).where("value <> ''").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return StructType.fromJson(json.loads(rows[0][0])) if rows else None


def read_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet") -> DataFrame:
    """SRC11/SRC14: a previous layer by catalog name, or by path."""
    if "/" in name_or_path:
        return spark.read.format(fmt).load(name_or_path)
    return spark.read.table(name_or_path)


def spread_input(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster runs
    tasks at once (a few large unsplittable files, or one Parquet row group),
    so CPU-heavy row work (parsing, hashing, regexes) is not done by one
    task.  A large input already has far more partitions than cores, and
    then this returns ``df`` unchanged (no shuffle)."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
