"""Registered queries over the driver tables (``/root/testdata/sf*``).

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
WHOLE tables.  The driver tables are clean (no NULLs, no malformed text),
so the messy legacy inputs the operators exist for are *derived* from them
by deterministic expressions on keys (a modulo decides which rows get a
fault; every row is still processed).  The same derivation is repeated in
the DuckDB oracle SQL (:mod:`strata.plans.oracle`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from strata.functions.codes import codes_for, map_codes
from strata.functions.dates import DEFAULT_TS_FORMATS, parse_date, parse_ts
from strata.functions.items import parse_items
from strata.functions.keys import md5_key, sha_key
from strata.functions.text import extract_block
from strata.operators.dedupe import keep_latest
from strata.operators.gold import (active_users, customer_value, customer_value_by_status,
                                   daily_revenue, daily_revenue_by_category,
                                   monthly_recurring_revenue)
from strata.operators.items import explode_items, item_reconciliation
from strata.operators.joins import (build_star, combine_accounts, join_dimension, join_nullable,
                                    lookup_category, map_codes_join, orphans)
from strata.operators.quality import TestSuite, failing_rows, reconcile, run_tests, split_valid
from strata.plans.banking import conform_customers
from strata.plans.ecommerce import (gold_revenue_by_category, gold_revenue_daily,
                                    latest_transactions, split_transactions,
                                    superseded_transactions, tagged_transactions)
from strata.plans.sql_models import RETURNING_REVENUE_SQL, run_model_sql
from strata.session import materialize
from strata.sources.files import spread_input
from strata.sources.rescue import rescue_json

D18_2 = DecimalType(18, 2)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table.  ``spread`` is for queries whose per-row work is
    heavy (parsing, hashing, regexes): a scan with fewer partitions than
    task slots is round-robined first (never the case on a large input)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_input(df) if spread else df


def _k(col: str, m: int) -> Column:
    return F.col(col) % F.lit(m)


# --------------------------------------------------------------------------
# derived inputs
# --------------------------------------------------------------------------

def render_date(ts: Column, idx: Column, bad: str = "invalid_date_here") -> Column:
    """Timestamp rendered in the pattern ``DEFAULT_TS_FORMATS[idx]``;
    ``idx == len(formats)`` renders an unparseable text."""
    out = F.when(idx == F.lit(len(DEFAULT_TS_FORMATS)), F.lit(bad))
    for i, f in enumerate(DEFAULT_TS_FORMATS):
        out = out.when(idx == F.lit(i), F.date_format(ts, f))
    return out


# Our order status code map for the silver-shaped orders.
ORDER_STATUS = {"F": "COMPLETED", "O": "PENDING", "P": "CANCELLED"}


def completed_transactions(orders: DataFrame, status: str | None = None) -> DataFrame:
    """Silver-shaped transactions from ``orders``: F/O/P -> COMPLETED /
    PENDING / CANCELLED, tax rate 0.00..0.09 from the key.  ``status``
    keeps only that status, filtered on the raw code so the predicate
    reaches the Parquet scan."""
    if status is not None:
        orders = orders.where(F.col("o_orderstatus").isin(codes_for(ORDER_STATUS, status)))
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("transaction_timestamp"),
        F.col("o_totalprice").cast(D18_2).alias("gross_amount"),
        ((_k("o_orderkey", 10)) * F.lit(0.01).cast(DecimalType(2, 2))).cast(DecimalType(5, 4)).alias("tax_rate"),
        map_codes("o_orderstatus", ORDER_STATUS, "UNKNOWN").alias("order_status"),
    )


def raw_transactions(orders: DataFrame) -> DataFrame:
    """Legacy transaction text built from ``orders`` with injected faults:
    NULL / padded customers, seven date renderings (one unparseable), the
    literal ``NULL`` and blank item lists, ``FREE`` amounts, mixed-case
    status, an unmapped payment code, missing order ids; and repeats: exact
    copies, later versions, and rows that tie in time but not in amount."""
    m20 = _k("o_orderkey", 20)
    kind = (F.when(m20 == 0, F.array(F.lit(0), F.lit(1))).when(m20 == 1, F.array(F.lit(0), F.lit(2)))
             .when(m20 == 2, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0))))
    o = orders.withColumn("kind", F.explode(kind))
    key, kind = F.col("o_orderkey"), F.col("kind")
    more = F.when(kind == 2, F.lit(5)).when(kind == 3, F.lit(1)).otherwise(F.lit(0)).cast(DecimalType(1, 0))
    amount = (F.col("o_totalprice").cast(D18_2) + more).cast(D18_2).cast("string")
    placed = F.when(kind == 2, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate"))
    cust = F.concat(F.lit("C_"), F.col("o_custkey").cast("string"))
    return o.select(
        F.when(_k("o_orderkey", 58) == 0, F.lit(" null"))
         .when(_k("o_orderkey", 29) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("O-"), key.cast("string"))).alias("order_id"),
        F.when(_k("o_orderkey", 13) == 0, F.lit(None).cast("string"))
         .when(_k("o_orderkey", 5) == 0, F.concat(F.lit("  "), cust, F.lit(" ")))
         .otherwise(cust).alias("cust_id"),
        render_date(placed, _k("o_orderkey", 7)).alias("txn_dt"),
        F.when(_k("o_orderkey", 4) == 0, F.lit("NULL"))
         .when(_k("o_orderkey", 4) == 1, F.lit(""))
         .otherwise(F.concat(F.lit("["), (F.col("o_custkey") % 300).cast("string"),
                             F.lit(":1:"), amount, F.lit("]"))).alias("item_details"),
        F.when(_k("o_orderkey", 17) == 0, F.lit("FREE")).otherwise(amount).alias("gross_amt"),
        ((_k("o_orderkey", 10)) * F.lit(0.01).cast(DecimalType(2, 2))).cast(DecimalType(3, 2))
         .cast("string").alias("tax_rate"),
        F.when(F.col("o_orderstatus") == "F",
               F.when(_k("o_orderkey", 3) == 0, F.lit(" completed")).otherwise(F.lit("COMPLETED")))
         .when(F.col("o_orderstatus") == "O", F.lit("PENDING"))
         .otherwise(F.lit("cancelled")).alias("status"),
        F.when(_k("o_orderkey", 5) == 0, F.lit("cc"))
         .when(_k("o_orderkey", 5) == 1, F.lit("paypal"))
         .when(_k("o_orderkey", 5) == 2, F.lit("giftcard"))
         .when(_k("o_orderkey", 5) == 3, F.lit("CreditCard"))
         .alias("p_method"),
        F.concat(F.lit("part-"), (key / 5000).cast("bigint").cast("string")).alias("_source_file"),
    )


def raw_line_items(lineitem: DataFrame) -> DataFrame:
    """One legacy item list per line: ``[part:1:extended price]``, a second
    item ``supp:quantity:tax`` on even lines, a malformed third item on
    every fifth line, and ``NULL`` / ``[]`` lists for some orders.  The
    header amount is the exact item total, off by 0.01 on one order in ten
    (a reconciliation failure).  All arithmetic is exact decimal."""
    ext = F.col("l_extendedprice").cast(D18_2)
    qty = F.col("l_quantity").cast("int")
    tax = F.col("l_tax").cast(DecimalType(4, 2))
    even = F.col("l_linenumber") % 2 == 0
    item1 = F.concat(F.col("l_partkey").cast("string"), F.lit(":1:"), ext.cast("string"))
    item2 = F.concat(F.lit("|"), F.col("l_suppkey").cast("string"), F.lit(":"),
                     qty.cast("string"), F.lit(":"), tax.cast("string"))
    body = F.concat(item1,
                    F.when(even, item2).otherwise(F.lit("")),
                    F.when(F.col("l_linenumber") % 5 == 0, F.lit("|x:1:bad")).otherwise(F.lit("")))
    text = (F.when(_k("l_orderkey", 19) == 0, F.lit("NULL"))
             .when(_k("l_orderkey", 23) == 0, F.lit("[]"))
             .otherwise(F.concat(F.lit("["), body, F.lit("]"))))
    total = ext + F.when(even, qty.cast(DecimalType(10, 0)) * tax).otherwise(F.lit(0).cast(DecimalType(4, 2)))
    header = F.when(_k("l_orderkey", 10) == 0, total + F.lit(0.01).cast(DecimalType(3, 2))).otherwise(total)
    return lineitem.select("l_orderkey", "l_linenumber", text.alias("item_details"),
                           header.cast(D18_2).cast("string").alias("header_amount"))


def raw_accounts(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Mainframe-style account records: one per order, owned by the order's
    customer; CHAR padding, a month-13 open date, an unmapped account type
    and status, NULL credit scores."""
    c = customer.select("c_custkey", "c_name", "c_mktsegment")
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    open_dt = F.when(_k("o_orderkey", 31) == 0,
                     F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("13"),
                              F.date_format("o_orderdate", "dd"))) \
               .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return j.select(
        F.rpad(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), 10, " ").alias("CUST_ID"),
        F.rpad(F.col("c_mktsegment"), 25, " ").alias("FIRST_NAME"),
        F.when(_k("o_orderkey", 2) == 0, F.lit("X")).alias("MID_INIT"),
        F.rpad(F.col("c_name"), 30, " ").alias("LAST_NAME"),
        open_dt.alias("OPEN_DT"),
        F.when(_k("o_orderkey", 4) == 0, F.lit("SV "))
         .when(_k("o_orderkey", 4) == 1, F.lit("CH"))
         .when(_k("o_orderkey", 4) == 2, F.lit(" CD"))
         .otherwise(F.lit("XX")).alias("ACCT_TYPE"),
        F.col("o_totalprice").cast(DecimalType(15, 2)).alias("CURR_BAL"),
        F.when(_k("c_custkey", 10) == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(500) + (F.col("c_custkey") * 37) % 350).cast("int")).alias("CR_SCORE"),
        F.when(_k("o_orderkey", 29) == 0, F.lit("Z"))
         .when(F.col("o_orderstatus") == "O", F.lit("A"))
         .when(F.col("o_orderstatus") == "F", F.lit("I"))
         .otherwise(F.lit("D")).alias("STATUS_CD"),
    )


def raw_event_json(events: DataFrame) -> DataFrame:
    """``events.props`` with injected drift: a non-numeric ``k``, an extra
    nested object, an extra scalar key, and unparseable records."""
    eid = F.col("event_id").cast("string")
    uid = F.col("user_id").cast("string")
    value = (F.when(_k("event_id", 97) == 0, F.concat(F.lit("{oops"), eid))
              .when(_k("event_id", 7) == 0, F.concat(F.lit('{"k": "bad'), eid, F.lit('"}')))
              .when(_k("event_id", 5) == 0, F.concat(F.lit('{"k": '), uid, F.lit(', "extra": {"z": '),
                                                    eid, F.lit("}}")))
              .when(_k("event_id", 3) == 0, F.concat(F.lit('{"k": '), uid, F.lit(', "src": "'),
                                                    F.col("event_type"), F.lit('"}')))
              .otherwise(F.col("props")))
    return events.select("event_id", value.alias("value"))


def fenced_text(conversations: DataFrame) -> DataFrame:
    """Conversation turns wrapped in fenced blocks of several shapes."""
    sel = (F.col("conv_id") * 7 + F.col("turn")) % 5
    t, role, turn = F.col("text"), F.col("role"), F.col("turn").cast("string")
    wrapped = (
        F.when(sel == 0, F.concat(F.lit("````SQL filename=models/gold/m.sql\n"), t,
                                  F.lit("\n````\nthen\n```yaml\n"), role, F.lit(": "), turn,
                                  F.lit("\n```")))
         .when(sel == 1, F.concat(F.lit("```sql\n"), t, F.lit("\n```\n```yml\nk: "), turn,
                                  F.lit("\n```")))
         .when(sel == 2, F.concat(F.lit("\n"), t, F.lit("\n")))
         .when(sel == 3, F.concat(F.lit("intro\n```python\n  "), t, F.lit("  \n```\n")))
         .otherwise(t))
    return conversations.select("conv_id", "turn", wrapped.alias("reply"))


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------

def q_daily_revenue(spark, sf):
    """G1 + W2 (flagship): completed orders per day, 7-row rolling average."""
    return daily_revenue(completed_transactions(table(spark, sf, "orders"), "COMPLETED"), window="rows")


def q_daily_revenue_calendar(spark, sf):
    """G1 + W3: the same with a 7-calendar-day frame."""
    return daily_revenue(completed_transactions(table(spark, sf, "orders"), "COMPLETED"), window="days")


def category_items(spark, sf) -> DataFrame:
    """Line items of fulfilled orders with revenue, tax and category."""
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F") \
        .select("o_orderkey", "o_orderdate")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"),
                                           F.col("p_type").alias("category"))
    items = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        (F.col("l_extendedprice").cast(D18_2)
         * (F.lit(1).cast(DecimalType(3, 2)) - F.col("l_discount").cast(DecimalType(4, 2)))
         ).alias("line_revenue"),
        F.col("l_tax").cast(DecimalType(4, 2)).alias("_tax_rate"),
    ).withColumn("line_tax", F.col("line_revenue") * F.col("_tax_rate"))
    return lookup_category(items, part, "item_id", "category", "Unknown")


def q_revenue_by_category_daily(spark, sf):
    """G2 + J2: day x part type, distinct orders, exact sums, 7-row rolling
    average per category."""
    return daily_revenue_by_category(category_items(spark, sf)).select(
        "transaction_date", "category", "order_count",
        F.col("daily_gross_revenue").cast(DecimalType(38, 4)).alias("daily_gross_revenue"),
        F.col("daily_tax_collected").cast(DecimalType(38, 6)).alias("daily_tax_collected"),
        "rolling_7d_avg_orders")


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


def line_order() -> list[str]:
    return ["l_shipdate"] + [c for c in LINEITEM_COLS if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]


def q_keep_latest_lineitem(spark, sf):
    """W1: latest line per (order, line number); ship date, then every
    other column, decides -- a total order."""
    return keep_latest(table(spark, sf, "lineitem"), LINE_KEY, line_order())


def q_keep_latest_event_per_user(spark, sf):
    """W1: latest event per user."""
    return keep_latest(table(spark, sf, "events"), ["user_id"],
                       [F.col("ts").desc_nulls_last(), F.col("event_id").desc()])


def q_parse_dates(spark, sf):
    """SC6 / PR3: seven renderings of the order date parsed back."""
    o = table(spark, sf, "orders", spread=True)
    raw = o.select("o_orderkey", render_date(F.col("o_orderdate"), _k("o_orderkey", 7)).alias("raw_date"))
    return raw.select("o_orderkey", "raw_date",
                      parse_ts("raw_date", DEFAULT_TS_FORMATS, ntz=True).alias("parsed_ts"))


def q_char_dates(spark, sf):
    """SC7: ``yyyyMMdd`` text with a month 13 on some rows."""
    o = table(spark, sf, "orders")
    raw = F.when(_k("o_orderkey", 11) == 0,
                 F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("13"),
                          F.date_format("o_orderdate", "dd"))) \
           .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", raw.alias("open_dt")) \
            .select("o_orderkey", "open_dt", parse_date("open_dt", "yyyyMMdd").alias("open_date"))


def transactions_tagged(spark, sf) -> DataFrame:
    """Legacy text derived from orders, conformed, each row with its reject reason."""
    return tagged_transactions(raw_transactions(table(spark, sf, "orders", spread=True)))


def q_conform_orders(spark, sf):
    """PR1-PR6, PR13, PR14, SC1, SC9, SRC7: the e-commerce silver conform
    (with keep-latest) over legacy text derived from every order."""
    silver = latest_transactions(transactions_tagged(spark, sf)).drop("_reject_reason")
    return silver.withColumn("transaction_timestamp",
                             F.col("transaction_timestamp").cast("timestamp_ntz"))


def transactions_silver(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) silver of the legacy text derived from orders."""
    return split_transactions(transactions_tagged(spark, sf))


def q_transactions_gold_daily(spark, sf):
    """Whole e-commerce flow on driver data: legacy text -> typed (rescue)
    -> keep-latest -> quarantine split -> G1 (unparseable dates are
    quarantined, lower-case statuses count as COMPLETED)."""
    valid, _ = transactions_silver(spark, sf)
    return gold_revenue_daily(valid)


def q_transactions_gold_by_category(spark, sf):
    """The same silver -> G2: line items parsed from the text, category from
    ``part.p_type`` (missing -> Unknown), per-category rolling average."""
    valid, _ = transactions_silver(spark, sf)
    dim = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"),
                                          F.col("p_type").alias("category"))
    g = gold_revenue_by_category(valid, dim)
    return g.select("transaction_date", "category", "order_count",
                    F.col("daily_gross_revenue").cast(DecimalType(38, 2)).alias("daily_gross_revenue"),
                    F.col("daily_tax_collected").cast(DecimalType(38, 6)).alias("daily_tax_collected"),
                    "rolling_7d_avg_orders")


def q_transactions_quarantine(spark, sf):
    """PR8 + SRC7 on the whole flow: the rows the silver split rejects, each
    with its reasons and the original text of its misfits (D5)."""
    _, quarantine = transactions_silver(spark, sf)
    return quarantine.select(
        "order_id", "customer_id", "raw_item_details", "gross_amount", "order_status",
        "_rescued_data", "_reject_reason")


def q_recurring_revenue_sql(spark, sf):
    """G7 as a SQL model over the silver layer (must equal ``recurring_revenue``)."""
    silver = completed_transactions(table(spark, sf, "orders"))
    return run_model_sql(spark, RETURNING_REVENUE_SQL, {"silver": silver}, {"gap": 1}).select(
        "month", "recurring_customers", F.col("recurring_revenue").cast(DecimalType(28, 2)).alias("recurring_revenue"))


def q_code_map(spark, sf):
    """PR5: order status and priority codes to words, unmapped -> default."""
    o = table(spark, sf, "orders")
    code = F.when(_k("o_orderkey", 9) == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    # Our words for the order status codes.
    status_words = {"F": "Fulfilled", "O": "Open", "P": "Partially fulfilled"}
    prio = F.split(F.col("o_orderpriority"), "-").getItem(0)
    prio_words = {"1": "Urgent", "2": "High", "3": "Medium", "4": "Not specified", "5": "Low"}
    return o.select("o_orderkey", code.alias("status_code"),
                    map_codes(code, status_words, "Other").alias("status_desc"),
                    map_codes(prio, prio_words, "Other").alias("priority_desc"))


def q_code_map_table(spark, sf):
    """PR5 for dictionaries held as data: customer nation codes mapped
    through the ``nation`` table (broadcast after its size check), with
    some codes shifted out of the dictionary -> default."""
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(_k("c_custkey", 17) == 0, F.col("c_nationkey") + F.lit(100))
         .otherwise(F.col("c_nationkey")).alias("nation_code"))
    return map_codes_join(c, "nation_code", table(spark, sf, "nation"), "n_nationkey", "n_name",
                          out="nation_name", default="Unknown")


def q_surrogate_keys(spark, sf):
    """SC1-SC3: SHA-256 over ``||``-joined keys (NULL skipped, and the opt-in
    NULL marker form) and MD5 of a trimmed CHAR key."""
    o = table(spark, sf, "orders")
    cust = F.when(_k("o_orderkey", 11) == 0, F.lit(None).cast("string")) \
            .otherwise(F.concat(F.lit("C_"), F.col("o_custkey").cast("string")))
    padded = F.rpad(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), 10, " ")
    base = o.select("o_orderkey", F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("order_id"),
                    cust.alias("cust_id"), padded.alias("cust_char"))
    return base.select("o_orderkey",
                       sha_key("order_id", "cust_id").alias("sk_transaction"),
                       sha_key("order_id", "cust_id", null_token="<NULL>").alias("sk_transaction_strict"),
                       md5_key("cust_char").alias("sk_customer"))


def parsed_line_items(spark, sf) -> DataFrame:
    return raw_line_items(table(spark, sf, "lineitem", spread=True)).withColumn("items", parse_items("item_details"))


def q_items_roundtrip(spark, sf):
    """SC12: parse the item lists and explode them (orders without items
    kept once, with NULL item fields)."""
    p = parsed_line_items(spark, sf)
    return explode_items(p, "items", keep=["l_orderkey", "l_linenumber"])


def q_item_totals(spark, sf):
    """G3: header amount vs sum of quantity x unit price per record."""
    p = parsed_line_items(spark, sf).withColumn(
        "header_amount", F.col("header_amount").try_cast(D18_2))
    rec = item_reconciliation(p, amount_col="header_amount", items_col="items", raw_col=None)
    return rec.select("l_orderkey", "l_linenumber", "header_amount", "items_total", "item_count",
                      "amount_matches")


def customer_silver(spark, sf) -> DataFrame:
    return conform_customers(raw_accounts(table(spark, sf, "customer"), table(spark, sf, "orders")))


def q_conform_customers(spark, sf):
    """Mainframe silver (PR1, PR2, PR5, SC2, SC4, SC7, SC9): trimmed CHAR
    fields, md5 key, ``yyyyMMdd`` dates (month 13 -> NULL), code maps.  The
    audit timestamp is left out (it differs per run)."""
    return customer_silver(spark, sf).drop("_silver_processed_at")


def q_accounts_by_type(spark, sf):
    """J3: one row per customer with a balance column per account type -- a
    single conditional aggregate, not a self-join per type."""
    types = ["Savings", "Checking", "Certificate of Deposit", "Unknown"]
    wide = combine_accounts(customer_silver(spark, sf), "customer_id", "account_type",
                            "current_balance", types)
    return wide.select("customer_id", *[F.col(f"`{t}`").alias(t.lower().replace(" ", "_"))
                                        for t in types])


def q_customer_value_by_status(spark, sf):
    """G4 (as shipped) + AG1/AG2/AG4/AG6 + PR10/PR11."""
    return customer_value_by_status(customer_silver(spark, sf))


def q_customer_value(spark, sf):
    """G5 + J3: one row per customer."""
    return customer_value(customer_silver(spark, sf))


def q_rescue_json(spark, sf):
    """SRC7 / ST4: JSON with drift and broken records; nothing fails."""
    return rescue_json(raw_event_json(table(spark, sf, "events", spread=True)), {"k": "int"})


def faulty_orders(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.when(_k("o_orderkey", 31) == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_orderkey")).alias("order_id"),
        F.when(_k("o_orderkey", 43) == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("customer_id"),
        F.when(_k("o_orderkey", 37) == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("o_orderdate")).alias("order_ts"),
        F.when(_k("o_orderkey", 41) == 0, -F.col("o_totalprice").cast(D18_2))
         .otherwise(F.col("o_totalprice").cast(D18_2)).alias("amount"),
        F.when(_k("o_orderkey", 47) == 0, F.lit("LOST")).otherwise(F.col("o_orderstatus")).alias("order_status"),
        (F.col("o_orderkey") / 2).cast("bigint").alias("pair_id"),
    )


def q_split_valid(spark, sf):
    """PR8: valid / quarantine split with every reason listed."""
    valid, quarantine = split_valid(faulty_orders(spark, sf), ["order_id", "customer_id", "order_ts"],
                                    {"non_negative_amount": F.col("amount") >= 0})
    return valid.select("o_orderkey", F.lit("valid").alias("outcome"),
                        F.lit("").alias("_reject_reason")) \
        .unionByName(quarantine.select("o_orderkey", F.lit("quarantine").alias("outcome"),
                                       "_reject_reason"))


def orders_suite(spark, sf) -> TestSuite:
    return TestSuite(model="orders_silver",
                     not_null=["order_id", "customer_id", "order_ts"],
                     unique=["order_id", "pair_id"],
                     accepted_values={"order_status": ["F", "O", "P"]},
                     relationships={"customer_id": (table(spark, sf, "customer"), "c_custkey")})


def q_dq_results(spark, sf):
    """DQ1-DQ5: one result table for a suite of declared tests."""
    return run_tests(faulty_orders(spark, sf), orders_suite(spark, sf))


def q_dq_failing_rows(spark, sf):
    """DQ5: the rows behind the failures of all four kinds of test, each with the tests it breaks; one customer
    in eleven is not in the parent table."""
    suite = orders_suite(spark, sf)
    suite.relationships = {"customer_id": (table(spark, sf, "customer").where("c_custkey % 11 <> 0"), "c_custkey")}
    return failing_rows(faulty_orders(spark, sf), suite).select("o_orderkey", F.array_join("_failed_tests", ";").alias("failed_tests"))


def q_orphans(spark, sf):
    """DQ4 / J4: orders whose (shifted) customer key has no customer."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(_k("o_orderkey", 53) == 0, F.col("o_custkey") + F.lit(10_000_000))
         .otherwise(F.col("o_custkey")).alias("cust_key"))
    return orphans(o, table(spark, sf, "customer"), "cust_key", "c_custkey")


def q_star_fact(spark, sf):
    """J5 + J1: orders fact with a hashed customer surrogate key, joined to
    the customer dimension denormalised with nation and region."""
    cust = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    geo = join_dimension(nation, region, nation["n_regionkey"] == region["r_regionkey"], "inner")
    dim_rows = join_dimension(cust, geo.select("n_nationkey", "n_name", "r_name"),
                              cust["c_nationkey"] == F.col("n_nationkey"), "left")
    o = table(spark, sf, "orders")
    fact, dims = build_star(o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
                            {"customer": (dim_rows, "c_custkey", "o_custkey")}, keep_natural=True)
    dim = dims["customer"].select("c_custkey", "c_mktsegment", "n_name", "r_name")
    return join_nullable(fact, dim, "o_custkey", "c_custkey").select(
        "o_orderkey", "sk_customer", "c_mktsegment", "n_name", "r_name",
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast(D18_2).alias("amount"))


def q_daily_active(spark, sf):
    """G6: daily active users."""
    return active_users(table(spark, sf, "events"), "day")


def q_weekly_active(spark, sf):
    """G6: weekly active users (weeks start on Monday)."""
    return active_users(table(spark, sf, "events"), "week")


def q_recurring_revenue(spark, sf):
    """G7: revenue of customers who also bought the month before."""
    tx = completed_transactions(table(spark, sf, "orders"))
    return monthly_recurring_revenue(tx).select(
        "month", "recurring_customers",
        F.col("recurring_revenue").cast(DecimalType(28, 2)).alias("recurring_revenue"))


def q_extract_blocks(spark, sf):
    """TX1 / TX2: first fenced block by language, with the fallbacks."""
    t = fenced_text(table(spark, sf, "conversations", spread=True))
    return t.select("conv_id", "turn",
                    extract_block("reply", "sql").alias("sql_block"),
                    extract_block("reply", "yaml").alias("yaml_block"),
                    extract_block("reply", "python").alias("python_block"))


def q_reconcile_layers(spark, sf):
    """DQ7: per source file, rows in = kept + superseded + quarantined, over the flow's
    real outputs; and the same with an output that lost rows, which must not balance."""
    bronze = raw_transactions(table(spark, sf, "orders", spread=True))
    tagged = materialize(tagged_transactions(bronze), "conformed")
    valid, quarantine = split_transactions(tagged)
    gone = superseded_transactions(tagged)
    flows = {"whole": valid, "lossy": valid.where(F.col("customer_id").isNotNull())}
    out = [reconcile({"rows_in": bronze, "kept": kept, "superseded": gone, "quarantined": quarantine})
           .select(F.lit(name).alias("flow"), "*") for name, kept in flows.items()]
    return out[0].unionByName(out[1])


def q_reconcile_content(spark, sf):
    """DQ7 by content: the flow's outputs hold the order ids, item texts and payment words of each source
    file, each as often; with the item texts of the kept rows changed, counts still balance, contents don't."""
    tagged = materialize(tagged_transactions(raw_transactions(table(spark, sf, "orders", spread=True))), "conformed")
    valid, quarantine = split_transactions(tagged)
    gone = superseded_transactions(tagged)
    changed = valid.withColumn("raw_item_details", F.concat(F.coalesce("raw_item_details", F.lit("")), F.lit("]")))
    out = [reconcile({"rows_in": tagged, "kept": kept, "superseded": gone, "quarantined": quarantine},
                     content=("order_id", "raw_item_details", "payment_method_raw"))
           .select(F.lit(name).alias("flow"), "*") for name, kept in {"whole": valid, "changed": changed}.items()]
    return out[0].unionByName(out[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "daily_revenue": q_daily_revenue,
    "daily_revenue_calendar": q_daily_revenue_calendar,
    "revenue_by_category_daily": q_revenue_by_category_daily,
    "keep_latest_lineitem": q_keep_latest_lineitem,
    "keep_latest_event_per_user": q_keep_latest_event_per_user,
    "parse_dates": q_parse_dates,
    "char_dates": q_char_dates,
    "conform_orders": q_conform_orders,
    "recurring_revenue_sql": q_recurring_revenue_sql,
    "transactions_gold_daily": q_transactions_gold_daily,
    "transactions_gold_by_category": q_transactions_gold_by_category,
    "transactions_quarantine": q_transactions_quarantine,
    "code_map": q_code_map,
    "code_map_table": q_code_map_table,
    "surrogate_keys": q_surrogate_keys,
    "items_roundtrip": q_items_roundtrip,
    "item_totals": q_item_totals,
    "conform_customers": q_conform_customers,
    "accounts_by_type": q_accounts_by_type,
    "customer_value_by_status": q_customer_value_by_status,
    "customer_value": q_customer_value,
    "rescue_json": q_rescue_json,
    "split_valid": q_split_valid,
    "dq_results": q_dq_results,
    "dq_failing_rows": q_dq_failing_rows,
    "orphans": q_orphans,
    "star_fact": q_star_fact,
    "daily_active": q_daily_active,
    "weekly_active": q_weekly_active,
    "recurring_revenue": q_recurring_revenue,
    "extract_blocks": q_extract_blocks,
    "reconcile_layers": q_reconcile_layers,
    "reconcile_content": q_reconcile_content,
}
