"""Test inputs (FIXTURES.md F1 rows, retyped)."""

# The raw transaction file rows (header + 10 rows).
LEGACY_CSV = """order_id,cust_id,txn_dt,item_details,gross_amt,tax_rate,status,p_method
O-9982,C_1082,2026/08/01 14:22:11,"[101:2:19.99|105:1:4.99]",44.97,0.08,COMPLETED,cc
O-9983,C_2201,02-Aug-2026,"[203:1:89.00]",89.00,0.00,PENDING,paypal
O-9983,C_2201,2026-08-02 11:00:00,"[203:1:89.00]",89.00,0.00,COMPLETED,paypal
O-9984,C_1082,2026-08-02 09:15:00,,0.00,0.08,CANCELLED,cc
O-9985,C_4022,2026/08/03,"[102:4:9.99]",39.96,0.05,completed,giftcard
O-9986,C_1082,2026-08-04,,FREE,0.08,COMPLETED,cc
O-9987,C_3301,05/08/2026 18:30:15,"[301:1:15.00]",15.00,0.05,COMPLETED,CreditCard
O-9988,,2026-08-06,"[105:10:4.99]",49.90,0.10,COMPLETED,cc
O-9989,C_5002,invalid_date_here,"[201:1:120.00]",120.00,0.05,COMPLETED,paypal
O-9982,C_1082,2026/08/01 14:22:11,"[101:2:19.99|105:1:4.99]",44.97,0.08,COMPLETED,cc
"""

# Item -> category dimension used by the by-category golden.
ITEM_CATEGORIES = [(101, "Accessories"), (102, "Accessories"), (105, "Stationery"),
                   (201, "Electronics"), (203, "Electronics"), (301, "Home")]


def write_csv(dirpath, name="transactions.csv", text=LEGACY_CSV):
    import os
    os.makedirs(dirpath, exist_ok=True)
    p = os.path.join(dirpath, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def read_legacy(spark, dirpath):
    """Batch bronze read of the fixture with ingest metadata."""
    from strata.plans.ecommerce import RAW_COLUMNS
    from strata.streaming.bronze import BronzeConfig, bronze_batch
    write_csv(dirpath)
    return bronze_batch(spark, BronzeConfig(dirpath, "", "", columns=RAW_COLUMNS))
