"""E-commerce transactions: raw CSV -> bronze -> silver -> gold.

Config-driven: rename map, ordered date patterns, code map, required
columns and null tokens are arguments with the shipped values as
defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from strata.functions.codes import PAYMENT_METHODS, map_codes
from strata.functions.dates import DEFAULT_TS_FORMATS
from strata.functions.items import parse_items
from strata.functions.keys import sha_key
from strata.functions.text import normalize_case, null_if_token
from strata.operators.dedupe import keep_latest, superseded
from strata.operators.gold import daily_revenue, daily_revenue_by_category
from strata.operators.items import explode_items
from strata.operators.joins import lookup_category
from strata.operators.quality import TestSuite, reject_reasons
from strata.sources.rescue import rescue_columns
from strata.streaming.bronze import BronzeConfig, bronze_stream
from strata.session import materialize
from strata.sources.sinks import append_batches, read_batches
from strata.streaming.silver import snapshot

# The raw transaction columns, in file order.
RAW_COLUMNS = ("order_id", "cust_id", "txn_dt", "item_details", "gross_amt",
               "tax_rate", "status", "p_method")


@dataclass
class TransactionConfig:
    formats: Sequence[str] = DEFAULT_TS_FORMATS
    payment_map: Mapping[str, str] = field(default_factory=lambda: dict(PAYMENT_METHODS))
    payment_default: str = "Other"
    null_token_columns: Sequence[str] = ("order_id", "item_details", "cust_id", "p_method", "status")
    required: Sequence[str] = ("order_id", "transaction_timestamp")
    null_token: str | None = None        # opt-in NULL marker for the surrogate key


def typed_transactions(bronze: DataFrame, cfg: TransactionConfig = TransactionConfig()) -> DataFrame:
    """Null tokens -> NULL, then cast through rescue: every misfit's text
    lands in ``_rescued_data``; typed columns get NULL."""
    df = bronze.withColumns({c: null_if_token(c) for c in cfg.null_token_columns if c in bronze.columns})
    return rescue_columns(df, {
        "txn_dt": "timestamp:" + "|".join(cfg.formats),
        "gross_amt": DecimalType(18, 2),
        "tax_rate": DecimalType(5, 4),
    })


#: Ties go by every other conformed column, so batch and stream keep the same row.
LATEST = ("transaction_timestamp", "_ingested_at")
KEY = ["order_id"]


def conform_transactions(typed: DataFrame, cfg: TransactionConfig = TransactionConfig()) -> DataFrame:
    """The conformed schema, row by row (no row is dropped or merged)."""
    extra = [c for c in ("_rescued_data", "_source_file", "_ingested_at") if c in typed.columns]
    return typed.select(
        sha_key("order_id", "cust_id", null_token=cfg.null_token).alias("sk_transaction"),
        F.col("order_id"),
        F.col("cust_id").alias("customer_id"),
        F.col("txn_dt").alias("transaction_timestamp"),
        F.col("item_details").alias("raw_item_details"),
        F.coalesce(F.col("gross_amt"), F.lit(0).cast(DecimalType(18, 2))).alias("gross_amount"),
        F.coalesce(F.col("tax_rate"), F.lit(0).cast(DecimalType(5, 4))).alias("tax_rate"),
        normalize_case("status", "UNKNOWN").alias("order_status"),
        F.col("p_method").alias("payment_method_raw"),
        map_codes("p_method", cfg.payment_map, cfg.payment_default).alias("payment_method"),
        *extra,
    )


def tagged_transactions(bronze: DataFrame, cfg: TransactionConfig = TransactionConfig()) -> DataFrame:
    """Bronze rows conformed, each with its ``_reject_reason`` ('' when it is valid).

    The one row-wise step of the batch and the streaming silver."""
    conformed = conform_transactions(typed_transactions(bronze, cfg), cfg)
    return conformed.withColumn("_reject_reason", reject_reasons(cfg.required))


def latest_transactions(rows: DataFrame) -> DataFrame:
    """The row kept of each order; rows without a key are none of them."""
    order = [c for c in LATEST if c in rows.columns]
    return keep_latest(rows.where(F.col("order_id").isNotNull()), KEY, order)


def split_transactions(tagged: DataFrame, store: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid silver, quarantine) of tagged rows.  ``store`` writes the kept rows once, so that
    flows that use both outputs rank once.

    Rows without a key go to quarantine as they are: there is nothing to rank
    them by.  Of each order the latest row is kept, and is quarantined when it is
    rejected.  The quarantine keeps ``_rescued_data`` and the reasons."""
    kept = latest_transactions(tagged)
    if store:
        kept = materialize(kept, "latest")
    valid = kept.where(F.col("_reject_reason") == "").drop("_reject_reason", "_rescued_data")
    quarantine = kept.where(F.col("_reject_reason") != "").unionByName(tagged.where(F.col("order_id").isNull()))
    return valid, quarantine


def superseded_transactions(tagged: DataFrame) -> DataFrame:
    """The rows of an order that its latest row replaces (for reconciliation)."""
    order = [c for c in LATEST if c in tagged.columns]
    return superseded(tagged.where(F.col("order_id").isNotNull()), KEY, order)


def silver_transactions(bronze: DataFrame, cfg: TransactionConfig = TransactionConfig(), store: bool = False
                        ) -> tuple[DataFrame, DataFrame]:
    """(valid silver, quarantine) of bronze rows.  ``store`` writes the conformed
    rows once, for flows that use both outputs."""
    tagged = tagged_transactions(bronze, cfg)
    return split_transactions(materialize(tagged, "conformed") if store else tagged)


def line_items(silver: DataFrame, item_dim: DataFrame | None = None,
               default_category: str = "Unknown") -> DataFrame:
    """One row per line item (orders without items kept once), with line
    revenue and tax and, given a dimension, the item category."""
    items = explode_items(silver.withColumn("items", parse_items("raw_item_details")),
                          "items", keep=[c for c in silver.columns])
    rev = F.coalesce(F.col("quantity").cast(DecimalType(10, 0)) * F.col("unit_price"),
                     F.lit(0).cast(DecimalType(18, 2)))
    items = (items.withColumn("transaction_date", F.col("transaction_timestamp").cast("date"))
                  .withColumn("line_revenue", rev)
                  .withColumn("line_tax", rev * F.col("tax_rate")))
    if item_dim is not None:
        items = lookup_category(items, item_dim, "item_id", "category", default_category)
    return items


def gold_revenue_daily(silver: DataFrame, window: str = "rows", status: str | None = "COMPLETED") -> DataFrame:
    """G1 on silver (completed orders only, unless ``status`` says otherwise)."""
    return daily_revenue(silver, window=window, status=status)


def gold_revenue_by_category(silver: DataFrame, item_dim: DataFrame, window: str = "rows") -> DataFrame:
    """G2 on silver: explode, categorise, aggregate per day and category."""
    items = line_items(silver.where(F.col("order_status") == "COMPLETED"), item_dim)
    return daily_revenue_by_category(items, window=window)


# The model's declared tests (dbt-style YAML block as data).
def gold_daily_suite() -> TestSuite:
    return TestSuite(
        model="revenue_by_category_daily",
        not_null=["transaction_date", "order_count", "daily_gross_revenue", "rolling_7d_avg_orders"],
        unique=["transaction_date"],
        docs={
            "transaction_date": "Day (UTC calendar date) the orders were placed.",
            "order_count": "Distinct completed orders on the day.",
            "daily_gross_revenue": "Sum of gross amounts of the day's completed orders, tax excluded.",
            "rolling_7d_avg_orders": "Mean order count of this row and the six rows before it.",
        })


def stream_bronze_transactions(spark, source_path: str, target_path: str, checkpoint: str):
    """ST1 for the transaction CSV files: all-string columns, rescue,
    ingest metadata, partitioned by ingest date."""
    cfg = BronzeConfig(source_path=source_path, target_path=target_path, checkpoint=checkpoint,
                       fmt="csv", columns=RAW_COLUMNS)
    return bronze_stream(spark, cfg)


def stream_silver_transactions(spark, bronze_path: str, rows_path: str, checkpoint: str,
                               cfg: TransactionConfig = TransactionConfig(),
                               max_files_per_trigger: int | None = None, available_now: bool = True):
    """ST3 for transactions: bronze Parquet -> tagged conformed rows, appended
    under ``rows_path`` (see ``transactions_snapshot`` for the silver)."""
    bronze = spark.read.parquet(bronze_path)
    r = spark.readStream.schema(bronze.schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    rows = tagged_transactions(r.parquet(bronze_path), cfg)
    return append_batches(rows, rows_path, checkpoint, available_now=available_now)


def transactions_snapshot(spark, rows_path: str, snapshots: str) -> tuple[DataFrame, DataFrame]:
    """(valid silver, quarantine) of all rows that the stream appended so far, each
    written as a new version and read back."""
    valid, quarantine = split_transactions(read_batches(spark, rows_path), store=True)
    return snapshot(valid, f"{snapshots}/valid"), snapshot(quarantine, f"{snapshots}/quarantine")
