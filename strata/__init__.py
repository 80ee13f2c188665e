"""strata: bronze / silver / gold lakehouse operators for PySpark.

Every public operator is a lazy ``DataFrame -> DataFrame`` (or a tuple of
DataFrames) built from Spark built-in expressions, so Catalyst can push
filters and projections into scans and whole-stage codegen covers the
hot path.  Sinks live in :mod:`strata.sources.sinks` and are kept apart
from transforms, so the same transform serves batch, stream and the
DuckDB parity checks.
"""

__version__ = "0.1.0"
