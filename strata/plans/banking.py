"""Mainframe customer master: fixed-width CHAR dump -> silver profile ->
customer value gold models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DecimalType, IntegerType, StringType, StructField,
                               StructType)

from strata.functions.casts import try_decimal, try_int
from strata.functions.codes import ACCOUNT_STATUSES, ACCOUNT_TYPES, map_codes
from strata.functions.dates import parse_date
from strata.functions.keys import md5_key
from strata.operators.conform import snake_case_columns
from strata.operators.gold import TIERS
from strata.operators.quality import TestSuite
from strata.streaming.bronze import BronzeConfig, bronze_stream

# The customer master record layout (CHAR columns arrive
# space-padded; nullability is checked by tests, readers ignore it).
CUST_MAST_SCHEMA = StructType([
    StructField("CUST_ID", StringType(), False),
    StructField("FIRST_NAME", StringType(), False),
    StructField("MID_INIT", StringType(), True),
    StructField("LAST_NAME", StringType(), False),
    StructField("OPEN_DT", StringType(), False),
    StructField("ACCT_TYPE", StringType(), False),
    StructField("CURR_BAL", DecimalType(15, 2), False),
    StructField("CR_SCORE", IntegerType(), True),
    StructField("STATUS_CD", StringType(), False),
])

# Explicit renames that snake_case alone would not produce.
RENAMES = {
    "CUST_ID": "customer_id",
    "MID_INIT": "middle_initial",
    "OPEN_DT": "account_open_date",
    "ACCT_TYPE": "account_type",
    "CURR_BAL": "current_balance",
    "CR_SCORE": "credit_score",
    "STATUS_CD": "account_status",
}


def conform_customers(bronze: DataFrame) -> DataFrame:
    """Trim CHAR padding, parse ``yyyyMMdd``, map codes, md5 surrogate key."""
    df = snake_case_columns(bronze.select(*CUST_MAST_SCHEMA.fieldNames()), RENAMES)
    return df.select(
        md5_key("customer_id").alias("sk_customer"),
        F.trim("customer_id").alias("customer_id"),
        F.trim("first_name").alias("first_name"),
        F.trim("middle_initial").alias("middle_initial"),
        F.trim("last_name").alias("last_name"),
        parse_date("account_open_date", "yyyyMMdd").alias("account_open_date"),
        map_codes("account_type", ACCOUNT_TYPES, "Unknown", trim=True).alias("account_type"),
        try_decimal("current_balance", 15, 2).alias("current_balance"),
        try_int("credit_score").alias("credit_score"),
        map_codes("account_status", ACCOUNT_STATUSES, "Other", trim=True).alias("account_status"),
        F.current_timestamp().alias("_silver_processed_at"),
    )


def customer_value_suite() -> TestSuite:
    return TestSuite(
        model="customer_lifetime_value",
        not_null=["customer_id", "customer_lifetime_value", "customer_tier", "is_dormant_risk"],
        unique=["customer_id"],
        accepted_values={"customer_tier": list(TIERS)},
        docs={
            "customer_id": "Customer number from the master file, padding removed.",
            "customer_lifetime_value": "Sum of the balances of all the customer's accounts.",
            "customer_tier": "Tier from total balance and credit score (first matching rule).",
            "is_dormant_risk": "True when dormant accounts hold more than 1,000.",
        })


def stream_bronze_customers(spark, source_path: str, target_path: str, checkpoint: str):
    """ST1 for the mainframe dump: Parquet with the declared record layout,
    ``_rescued_data`` always present, partitioned by ingest date."""
    cfg = BronzeConfig(source_path=source_path, target_path=target_path, checkpoint=checkpoint,
                       fmt="parquet", schema=CUST_MAST_SCHEMA)
    return bronze_stream(spark, cfg)
