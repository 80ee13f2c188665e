"""Gold models written as SQL (SRC14, PR12).  A model names the layers that it reads;
they are bound as arguments of the statement, so nothing is registered in the
session, and its numbers are bound as parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def run_model_sql(spark: SparkSession, sql: str, refs: Mapping[str, DataFrame],
                  params: Mapping[str, object] | None = None) -> DataFrame:
    """Run ``sql`` with each ``{name}`` bound to ``refs[name]`` and each ``:name`` to a
    parameter.  Catalyst sees one plan, as for the DataFrame form."""
    return spark.sql(sql, args=dict(params or {}), **refs)


# G7: customers of a month who had also bought ``:gap`` months before.  Counts each
# customer's months once, then meets each month with the one ``:gap`` later.
RETURNING_REVENUE_SQL = """
WITH bought AS (
    SELECT customer_id,
           trunc(CAST(transaction_timestamp AS DATE), 'MM') AS month,
           sum(gross_amount)                                AS spent
    FROM {silver}
    WHERE customer_id IS NOT NULL AND transaction_timestamp IS NOT NULL
    GROUP BY ALL
)
SELECT now.month,
       count(*)       AS recurring_customers,
       sum(now.spent) AS recurring_revenue
FROM bought AS now
LEFT SEMI JOIN bought AS earlier
  ON earlier.customer_id = now.customer_id
 AND add_months(earlier.month, :gap) = now.month
GROUP BY now.month
"""
