from decimal import Decimal

from strata.operators.gold import customer_value, customer_value_by_status
from strata.operators.quality import run_tests, unique
from strata.plans.banking import CUST_MAST_SCHEMA, conform_customers, customer_value_suite

# FIXTURES F3 account rows, as they arrive (CHAR padded).
RAW = [
    ("C1        ", "Ann", None, "Lee", "20200101", "SV ", Decimal("20000.00"), 700, "A"),
    ("C1        ", "Ann", None, "Lee", "20200101", "CH", Decimal("6000.00"), 700, "D"),
    ("C2        ", "Bob", "Q", "Ray", "20260801", "SV", Decimal("30000.00"), None, "A"),
    ("C3        ", "Cy", None, "Fox", "20261301", "CD", Decimal("10.00"), 760, "I"),
    ("C4        ", "Di", None, "Orr", "20210505", "CH", Decimal("1000.00"), 640, "D"),
    ("C5        ", "Ed", None, "Kay", "20220202", "SV", Decimal("100000.00"), 600, "A"),
]


def _silver(spark):
    return conform_customers(spark.createDataFrame(RAW, CUST_MAST_SCHEMA))


def test_conform(spark):
    rows = _silver(spark).collect()
    r0 = rows[0]
    assert r0.customer_id == "C1" and r0.account_type == "Savings" and r0.account_status == "Active"
    assert r0.sk_customer == spark.sql("select md5('C1') m").first().m
    by_id = {(r.customer_id, r.account_status): r for r in rows}
    assert str(by_id[("C2", "Active")].account_open_date) == "2026-08-01"
    assert by_id[("C3", "Inactive")].account_open_date is None
    assert by_id[("C3", "Inactive")].account_type == "Certificate of Deposit"
    assert by_id[("C2", "Active")].middle_initial == "Q"
    assert "_silver_processed_at" in _silver(spark).columns


def test_unmapped_codes(spark):
    raw = [("X1", "A", None, "B", "20260801", "ZZ", Decimal("1.00"), 1, "Q")]
    r = conform_customers(spark.createDataFrame(raw, CUST_MAST_SCHEMA)).first()
    assert (r.account_type, r.account_status) == ("Unknown", "Other")


def test_value_by_status_as_shipped(spark):
    g = customer_value_by_status(_silver(spark))
    got = sorted((r.customer_id, r.account_status, f"{r.active_balance:.2f}",
                  f"{r.customer_lifetime_value:.2f}", r.distinct_accounts, r.customer_tier[5],
                  r.is_dormant_risk) for r in g.collect())
    assert got == [
        ("C1", "Active", "20000.00", "20000.00", 1, "3", False),
        ("C1", "Dormant", "0.00", "6000.00", 1, "3", True),
        ("C2", "Active", "30000.00", "30000.00", 1, "3", False),
        ("C3", "Inactive", "0.00", "10.00", 1, "1", False),
        ("C4", "Dormant", "0.00", "1000.00", 1, "3", False),
        ("C5", "Active", "100000.00", "100000.00", 1, "1", False),
    ]
    assert unique(g, "customer_id").first().failures == 1


def test_value_per_customer(spark):
    g = customer_value(_silver(spark))
    got = sorted((r.customer_id, f"{r.active_balance:.2f}", f"{r.dormant_balance:.2f}",
                  f"{r.customer_lifetime_value:.2f}", r.distinct_accounts, r.customer_tier,
                  r.is_dormant_risk) for r in g.collect())
    assert got == [
        ("C1", "20000.00", "6000.00", "26000.00", 2, "Tier 2 (Gold)", True),
        ("C2", "30000.00", "0.00", "30000.00", 1, "Tier 3 (Standard)", False),
        ("C3", "0.00", "0.00", "10.00", 1, "Tier 1 (Platinum)", False),
        ("C4", "0.00", "1000.00", "1000.00", 1, "Tier 3 (Standard)", False),
        ("C5", "100000.00", "0.00", "100000.00", 1, "Tier 1 (Platinum)", False),
    ]
    res = {(r.column_name, r.test): r.failures for r in run_tests(g, customer_value_suite()).collect()}
    assert res[("customer_id", "unique")] == 0
    assert res[("customer_tier", "accepted_values")] == 0
    assert all(v == 0 for v in res.values())


def test_mainframe_parquet_bronze_stream(spark, tmp_dir):
    import os

    from strata.plans.banking import stream_bronze_customers
    src = os.path.join(tmp_dir, "dump")
    spark.createDataFrame(RAW, CUST_MAST_SCHEMA).coalesce(1).write.parquet(src)
    out, ckpt = os.path.join(tmp_dir, "bronze"), os.path.join(tmp_dir, "ckpt")
    stream_bronze_customers(spark, src, out, ckpt)
    stream_bronze_customers(spark, src, out, ckpt)          # restart adds nothing
    bronze = spark.read.parquet(out)
    assert bronze.count() == len(RAW)
    assert {"_rescued_data", "_ingested_at", "_source_file", "_ingest_date"} <= set(bronze.columns)
    g = {r.customer_id: r.customer_tier for r in customer_value(conform_customers(bronze)).collect()}
    assert g["C1"] == "Tier 2 (Gold)" and g["C5"] == "Tier 1 (Platinum)"


def test_parquet_new_column_is_rescued(spark, tmp_dir):
    import json
    import os

    from pyspark.sql import functions as F

    from strata.plans.banking import stream_bronze_customers
    src = os.path.join(tmp_dir, "dump")
    base = spark.createDataFrame(RAW[:2], CUST_MAST_SCHEMA)
    base.coalesce(1).write.parquet(os.path.join(src, "day1"))
    out, ckpt = os.path.join(tmp_dir, "bronze"), os.path.join(tmp_dir, "ckpt")
    # recursive listing: day folders below the source folder
    stream_bronze_customers(spark, src + "/*", out, ckpt)
    base.withColumn("EMAIL", F.lit("a@b.c")).coalesce(1).write.parquet(os.path.join(src, "day2"))
    stream_bronze_customers(spark, src + "/*", out, ckpt)     # dump now has a new column
    bronze = spark.read.parquet(out)
    assert bronze.count() == 4 and "EMAIL" not in bronze.columns
    rescued = [json.loads(r._rescued_data) for r in bronze.collect() if r._rescued_data]
    assert rescued == [{"EMAIL": "a@b.c"}] * 2
