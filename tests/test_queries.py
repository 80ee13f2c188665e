"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in E.queries() if n in E.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, SF, name, E.queries()[name], E.oracle_sql().get(name))
    assert ok, msg


def test_every_query_has_an_oracle():
    from strata.plans.catalog import QUERIES
    from strata.plans.streams import STREAM_QUERIES
    assert {*QUERIES, *STREAM_QUERIES} <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["transaction_date", "order_count", "daily_gross_revenue",
                          "daily_tax_collected", "rolling_7d_avg_orders"]
    assert df.count() > 0
