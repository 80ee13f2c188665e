from decimal import Decimal

from pyspark.sql import functions as F

from fixtures import ITEM_CATEGORIES, read_legacy
from strata.operators.quality import reconcile, run_tests
from strata.plans.ecommerce import (gold_daily_suite, latest_transactions, tagged_transactions,
                                    gold_revenue_by_category, gold_revenue_daily,
                                    silver_transactions, superseded_transactions,
                                    split_transactions)

EXPECTED_SILVER = {
    # order_id: (sk prefix, customer, ts, gross, rate, status, payment)
    "O-9982": ("a560d1b3140f", "C_1082", "2026-08-01 14:22:11", "44.97", "0.0800", "COMPLETED", "Credit Card"),
    "O-9983": ("f32b5d37d1a2", "C_2201", "2026-08-02 11:00:00", "89.00", "0.0000", "COMPLETED", "PayPal"),
    "O-9984": ("d94f39c9d1dc", "C_1082", "2026-08-02 09:15:00", "0.00", "0.0800", "CANCELLED", "Credit Card"),
    "O-9985": ("ab37569098fe", "C_4022", "2026-08-03 00:00:00", "39.96", "0.0500", "COMPLETED", "Gift Card"),
    "O-9986": ("45449ebb0b2c", "C_1082", "2026-08-04 00:00:00", "0.00", "0.0800", "COMPLETED", "Credit Card"),
    "O-9987": ("c364463bda99", "C_3301", "2026-08-05 18:30:15", "15.00", "0.0500", "COMPLETED", "Other"),
    "O-9988": ("4fa52e916c6d", None, "2026-08-06 00:00:00", "49.90", "0.1000", "COMPLETED", "Credit Card"),
    "O-9989": ("ad985c79a203", "C_5002", None, "120.00", "0.0500", "COMPLETED", "PayPal"),
}


def _silver_all(spark, tmp_dir):
    bronze = read_legacy(spark, tmp_dir + "/raw")
    return bronze, latest_transactions(tagged_transactions(bronze))


def test_silver_golden(spark, tmp_dir):
    _, silver = _silver_all(spark, tmp_dir)
    rows = {r.order_id: r for r in silver.collect()}
    assert set(rows) == set(EXPECTED_SILVER)
    for oid, (sk, cust, ts, gross, rate, status, pay) in EXPECTED_SILVER.items():
        r = rows[oid]
        assert r.sk_transaction.startswith(sk), oid
        assert r.customer_id == cust
        got_ts = None if r.transaction_timestamp is None else r.transaction_timestamp.strftime("%Y-%m-%d %H:%M:%S")
        assert got_ts == ts, oid
        assert r.gross_amount == Decimal(gross) and str(r.gross_amount) == gross
        assert str(r.tax_rate) == rate
        assert r.order_status == status and r.payment_method == pay
    assert dict(silver.dtypes)["gross_amount"] == "decimal(18,2)"
    assert dict(silver.dtypes)["tax_rate"] == "decimal(5,4)"


def test_rescued_data(spark, tmp_dir):
    _, silver = _silver_all(spark, tmp_dir)
    res = {r.order_id: r._rescued_data for r in silver.collect()}
    assert res["O-9986"] == '{"gross_amt":"FREE"}'
    assert res["O-9989"] == '{"txn_dt":"invalid_date_here"}'
    assert all(v is None for k, v in res.items() if k not in ("O-9986", "O-9989"))


def test_split_and_reconcile(spark, tmp_dir):
    bronze = read_legacy(spark, tmp_dir + "/raw")
    valid, quarantine = silver_transactions(bronze)
    assert valid.count() == 7
    q = quarantine.collect()
    assert [r.order_id for r in q] == ["O-9989"]
    assert q[0]._reject_reason == "missing:transaction_timestamp"
    assert "_rescued_data" not in valid.columns
    sup = superseded_transactions(tagged_transactions(bronze))
    rec = reconcile({"rows_in": bronze, "kept": valid, "superseded": sup,
                     "quarantined": quarantine}).collect()
    assert len(rec) == 1
    r = rec[0]
    assert (r.rows_in, r.kept, r.superseded, r.quarantined, r.balanced) == (10, 7, 2, 1, True)


def test_gold_by_day(spark, tmp_dir):
    valid, _ = silver_transactions(read_legacy(spark, tmp_dir + "/raw"))
    g = gold_revenue_daily(valid).orderBy("transaction_date").collect()
    got = [(str(r.transaction_date), r.order_count, str(r.daily_gross_revenue),
            str(r.daily_tax_collected), r.rolling_7d_avg_orders) for r in g]
    assert got == [
        ("2026-08-01", 1, "44.97", "3.597600", 1.0),
        ("2026-08-02", 1, "89.00", "0.000000", 1.0),
        ("2026-08-03", 1, "39.96", "1.998000", 1.0),
        ("2026-08-04", 1, "0.00", "0.000000", 1.0),
        ("2026-08-05", 1, "15.00", "0.750000", 1.0),
        ("2026-08-06", 1, "49.90", "4.990000", 1.0),
    ]
    t = {(r.column_name, r.test): r.failures for r in run_tests(
        gold_revenue_daily(valid), gold_daily_suite()).collect()}
    assert all(v == 0 for v in t.values())


def test_gold_without_quarantine_has_null_day(spark, tmp_dir):
    bronze = read_legacy(spark, tmp_dir + "/raw")
    silver = latest_transactions(tagged_transactions(bronze))
    # the gold model drops NULL dates itself; the quarantine holds the row
    days = [r.transaction_date for r in gold_revenue_daily(silver).collect()]
    assert None not in days and len(days) == 6


def test_gold_by_category(spark, tmp_dir):
    valid, _ = silver_transactions(read_legacy(spark, tmp_dir + "/raw"))
    dim = spark.createDataFrame(ITEM_CATEGORIES, "item_id int, category string")
    g = gold_revenue_by_category(valid, dim).orderBy("transaction_date", "category").collect()
    got = [(str(r.transaction_date), r.category, r.order_count,
            f"{r.daily_gross_revenue:.2f}", f"{r.daily_tax_collected:.6f}") for r in g]
    assert got == [
        ("2026-08-01", "Accessories", 1, "39.98", "3.198400"),
        ("2026-08-01", "Stationery", 1, "4.99", "0.399200"),
        ("2026-08-02", "Electronics", 1, "89.00", "0.000000"),
        ("2026-08-03", "Accessories", 1, "39.96", "1.998000"),
        ("2026-08-04", "Unknown", 1, "0.00", "0.000000"),
        ("2026-08-05", "Home", 1, "15.00", "0.750000"),
        ("2026-08-06", "Stationery", 1, "49.90", "4.990000"),
    ]


def test_line_items_golden(spark, tmp_dir):
    from strata.operators.items import item_reconciliation
    from strata.plans.ecommerce import line_items
    _, silver = _silver_all(spark, tmp_dir)
    items = line_items(silver).collect()
    got = {}
    for r in items:
        got.setdefault(r.order_id, []).append(
            None if r.item_id is None else (r.item_id, r.quantity, str(r.unit_price)))
    assert got == {
        "O-9982": [(101, 2, "19.99"), (105, 1, "4.99")], "O-9983": [(203, 1, "89.00")],
        "O-9984": [None], "O-9985": [(102, 4, "9.99")], "O-9986": [None],
        "O-9987": [(301, 1, "15.00")], "O-9988": [(105, 10, "4.99")], "O-9989": [(201, 1, "120.00")],
    }
    rec = item_reconciliation(silver).collect()
    assert len(rec) == 8 and all(r.amount_matches for r in rec)


def test_rows_without_a_key_are_all_quarantined(spark):
    rows = [(None, "C_1", f"2026-08-0{i}", None, str(i), "0.1", "x", "cc") for i in range(1, 5)]
    rows += [(" null ", "C_1", "2026-08-09", None, "9", "0.1", "x", "cc"), ("O-1", "C_1", "2026-08-01", None, "1", "0.1", "x", "cc"),
             ("O-1", "C_1", "bad", None, "2", "0.1", "x", "cc")]
    bronze = spark.createDataFrame(rows, "order_id string, cust_id string, txn_dt string, item_details string, "
                                         "gross_amt string, tax_rate string, status string, p_method string")
    valid, quarantine = split_transactions(tagged_transactions(bronze))
    assert [r.order_id for r in valid.collect()] == ["O-1"]
    assert sorted(r.gross_amount for r in quarantine.collect()) == [1, 2, 3, 4, 9]
    assert superseded_transactions(tagged_transactions(bronze)).count() == 1


def test_ties_do_not_depend_on_row_order(spark):
    rows = [("O-1", "C_1", "2026-08-01", None, str(i), "0.1", s, "cc") for i in range(20) for s in ("a", "b")]
    bronze = spark.createDataFrame(rows, "order_id string, cust_id string, txn_dt string, item_details string, "
                                         "gross_amt string, tax_rate string, status string, p_method string")
    kept = {tuple(latest_transactions(tagged_transactions(bronze.orderBy(F.rand(i)).repartition(3))).first()) for i in range(3)}
    assert len(kept) == 1
