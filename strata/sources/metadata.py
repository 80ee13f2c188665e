"""Ingest metadata (SRC8, SRC9)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_ingest_metadata(df: DataFrame, partition_col: str | None = "_ingest_date",
                         source_file: Column | None = None) -> DataFrame:
    """Add ``_ingested_at`` (one value per micro-batch / query), ``_source_file``
    (given, or from the hidden ``_metadata`` column of file sources; NULL where a
    frame has none) and a date partition column for the bronze layout."""
    if source_file is None:
        source_file = F.col("_metadata.file_path") if has_file_metadata(df) else F.lit(None).cast("string")
    out = df.withColumn("_source_file", source_file).withColumn("_ingested_at", F.current_timestamp())
    if partition_col:
        out = out.withColumn(partition_col, F.to_date(F.col("_ingested_at")))
    return out


def has_file_metadata(df: DataFrame) -> bool:
    """Whether the frame reads files and still carries their hidden column."""
    try:
        df.select("_metadata.file_path").schema  # noqa: B018 -- analysis alone decides
    except AnalysisException as e:
        if "UNRESOLVED_COLUMN" in (e.getCondition() or ""):
            return False
        raise
    return True
