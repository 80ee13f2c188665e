"""Gold models (AG1-AG6, G1, G2, G4-G7, PR7, PR10, PR11).

Shuffle shape of the daily models: ``count(DISTINCT order)`` with other
aggregates is planned by Catalyst as a two-level aggregate -- partial
sums per (day, order) before the first exchange, partial counts per day
before the second -- so a day holding a third of all orders is reduced
map-side and never lands whole on one reducer.  The rolling window then
runs over one row per day (per category), a bounded input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from strata.operators.windows import rolling_days, rolling_rows

# Tier labels and thresholds of the customer model.
TIER_1 = "Tier 1 (Platinum)"
TIER_2 = "Tier 2 (Gold)"
TIER_3 = "Tier 3 (Standard)"
TIERS = (TIER_1, TIER_2, TIER_3)
TIER_1_VALUE = 100000
TIER_1_SCORE = 750
TIER_2_VALUE = 25000
TIER_2_SCORE = 650
DORMANT_RISK_BALANCE = 1000


def daily_revenue(tx: DataFrame, date_col: str = "transaction_date",
                  ts_col: str | None = "transaction_timestamp",
                  order_col: str = "order_id", amount: str = "gross_amount",
                  rate: str = "tax_rate", status_col: str = "order_status",
                  status: str | None = "COMPLETED", window: str = "rows",
                  n: int = 7) -> DataFrame:
    """G1: per day, distinct orders, gross revenue, tax (exact decimals) and
    a rolling average of the order count.  ``window='rows'`` is the shipped
    7-row frame (W2), ``'days'`` a 7-calendar-day frame (W3).  Rows with no
    date are left out (they belong to the quarantine, not to a NULL day)."""
    df = tx
    if status is not None:
        df = df.where(F.col(status_col) == F.lit(status))
    if ts_col is not None and date_col not in df.columns:
        df = df.withColumn(date_col, F.col(ts_col).cast("date"))
    df = df.where(F.col(date_col).isNotNull())
    daily = df.groupBy(date_col).agg(
        F.count_distinct(F.col(order_col)).alias("order_count"),
        F.sum(F.col(amount)).alias("daily_gross_revenue"),
        F.sum(F.col(amount) * F.col(rate)).alias("daily_tax_collected"),
    )
    out = "rolling_7d_avg_orders" if n == 7 else f"rolling_{n}d_avg_orders"
    if window == "rows":
        return rolling_rows(daily, "order_count", date_col, n, out=out)
    if window == "days":
        return rolling_days(daily, "order_count", date_col, n, out=out)
    raise ValueError(f"window must be 'rows' or 'days', not {window!r}")


def daily_revenue_by_category(items: DataFrame, date_col: str = "transaction_date",
                              category: str = "category", order_col: str = "order_id",
                              revenue: str = "line_revenue", tax: str = "line_tax",
                              n: int = 7, window: str = "rows") -> DataFrame:
    """G2: day x category from exploded, categorised line items.  The rolling
    average is per category (``partitionBy(category)``)."""
    df = items.where(F.col(date_col).isNotNull())
    daily = df.groupBy(date_col, category).agg(
        F.count_distinct(F.col(order_col)).alias("order_count"),
        F.sum(F.col(revenue)).alias("daily_gross_revenue"),
        F.sum(F.col(tax)).alias("daily_tax_collected"),
    )
    out = "rolling_7d_avg_orders" if n == 7 else f"rolling_{n}d_avg_orders"
    if window == "rows":
        return rolling_rows(daily, "order_count", date_col, n, partition_by=[category], out=out)
    return rolling_days(daily, "order_count", date_col, n, partition_by=[category], out=out)


def customer_tier(value: Column, score: Column) -> Column:
    """PR10: first match wins; a NULL score never satisfies a score test
    (three-valued logic), so it can only reach tier 1 by value."""
    return (F.when((value >= TIER_1_VALUE) | (score >= TIER_1_SCORE), F.lit(TIER_1))
             .when((value >= TIER_2_VALUE) & (score >= TIER_2_SCORE), F.lit(TIER_2))
             .otherwise(F.lit(TIER_3)))


def flag(predicate: Column) -> Column:
    """PR11: TRUE when the predicate holds, FALSE otherwise -- never NULL."""
    return F.when(predicate, F.lit(True)).otherwise(F.lit(False))


def _active_sum(status: str, bal: str) -> Column:
    return F.sum(F.when(F.col("account_status") == F.lit(status), F.col(bal))
                 .otherwise(F.lit(0).cast(DecimalType(15, 2))))


def customer_value_by_status(cust: DataFrame, balance: str = "current_balance") -> DataFrame:
    """G4, as shipped: grouped by customer, names, score *and* status, so a
    customer with active and dormant accounts gets one row per status."""
    keys = ["customer_id", "first_name", "last_name", "credit_score", "account_status"]
    agg = cust.groupBy(*keys).agg(
        _active_sum("Active", balance).alias("active_balance"),
        F.sum(F.col(balance)).alias("customer_lifetime_value"),
        F.count_distinct(F.col("account_type")).alias("distinct_accounts"),
    )
    return agg.select(
        *keys, "active_balance", "customer_lifetime_value", "distinct_accounts",
        customer_tier(F.col("customer_lifetime_value"), F.col("credit_score")).alias("customer_tier"),
        flag((F.col("account_status") == F.lit("Dormant"))
             & (F.col("customer_lifetime_value") > DORMANT_RISK_BALANCE)).alias("is_dormant_risk"),
    )


def customer_value(cust: DataFrame, balance: str = "current_balance") -> DataFrame:
    """G5: one row per customer (``unique(customer_id)`` holds).  Names and
    score are the max over the customer's accounts; the dormant flag looks
    at the dormant balance, not the lifetime value."""
    agg = cust.groupBy("customer_id").agg(
        F.max("first_name").alias("first_name"),
        F.max("last_name").alias("last_name"),
        F.max("credit_score").alias("credit_score"),
        _active_sum("Active", balance).alias("active_balance"),
        _active_sum("Dormant", balance).alias("dormant_balance"),
        F.sum(F.col(balance)).alias("customer_lifetime_value"),
        F.count_distinct(F.col("account_type")).alias("distinct_accounts"),
    )
    return agg.select(
        "customer_id", "first_name", "last_name", "credit_score", "active_balance",
        "dormant_balance", "customer_lifetime_value", "distinct_accounts",
        customer_tier(F.col("customer_lifetime_value"), F.col("credit_score")).alias("customer_tier"),
        flag(F.col("dormant_balance") > DORMANT_RISK_BALANCE).alias("is_dormant_risk"),
    )


def active_users(events: DataFrame, grain: str = "day", ts_col: str = "ts",
                 user_col: str = "user_id") -> DataFrame:
    """G6: distinct users per ``day`` / ``week`` (ISO week, Monday start) /
    ``month``.  Exact distinct; partial de-duplication happens map-side."""
    if grain not in ("day", "week", "month"):
        raise ValueError(f"grain must be day, week or month, not {grain!r}")
    period = F.date_trunc(grain, F.col(ts_col)).cast("date")
    return (events.where(F.col(ts_col).isNotNull())
            .groupBy(period.alias("period_start"))
            .agg(F.count_distinct(F.col(user_col)).alias("active_users")))


def monthly_recurring_revenue(tx: DataFrame, customer: str = "customer_id",
                              ts_col: str = "transaction_timestamp",
                              amount: str = "gross_amount") -> DataFrame:
    """G7 (our definition): per month, revenue of customers who also bought
    in the previous calendar month.  Aggregate to (customer, month) first,
    so the ``lag`` window sees at most one row per customer-month."""
    m = (tx.where(F.col(ts_col).isNotNull() & F.col(customer).isNotNull())
           .groupBy(F.col(customer).alias("customer"),
                    F.trunc(F.col(ts_col).cast("date"), "month").alias("month"))
           .agg(F.sum(F.col(amount)).alias("revenue")))
    w = Window.partitionBy("customer").orderBy("month")
    m = m.withColumn("prev_month", F.lag("month").over(w))
    rec = m.where(F.col("prev_month") == F.add_months(F.col("month"), -1))
    return rec.groupBy("month").agg(
        F.count(F.lit(1)).alias("recurring_customers"),
        F.sum("revenue").alias("recurring_revenue"))
