import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.functions.codes import PAYMENT_METHODS, map_codes
from strata.functions.dates import DEFAULT_TS_FORMATS, parse_date, parse_ts, shape_regex
from strata.functions.items import items_total, parse_items
from strata.functions.keys import md5_key, sha_key
from strata.functions.text import extract_block, null_if_token


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_sha_key_skips_null(spark):
    df = spark.createDataFrame([("O-9988", None)], "o string, c string")
    r = df.select(sha_key("o", "c").alias("a"), F.sha2(F.lit("O-9988"), 256).alias("b"),
                  sha_key("o", "c", null_token="<NULL>").alias("s")).first()
    assert r.a == r.b and r.s != r.a


def test_md5_key_trims(spark):
    assert one(spark, md5_key("x"), "C1        ") == one(spark, F.md5(F.lit("C1")), "C1")


@pytest.mark.parametrize("text,expected", [
    ("2026/08/01 14:22:11", dt.datetime(2026, 8, 1, 14, 22, 11)),
    ("02-Aug-2026", dt.datetime(2026, 8, 2)),
    ("2026-08-02 09:15:00", dt.datetime(2026, 8, 2, 9, 15)),
    ("2026-08-04", dt.datetime(2026, 8, 4)),
    ("2026/08/03", dt.datetime(2026, 8, 3)),
    ("05/08/2026 18:30:15", dt.datetime(2026, 8, 5, 18, 30, 15)),
    ("invalid_date_here", None),
    (None, None),
])
def test_parse_ts(spark, text, expected):
    got = one(spark, parse_ts("x", DEFAULT_TS_FORMATS, ntz=True), text)
    assert got == expected


def test_parse_date(spark):
    assert one(spark, parse_date("x"), "20260801") == dt.date(2026, 8, 1)
    assert one(spark, parse_date("x"), "20261301") is None


def test_shape_regex_is_permissive():
    import re
    for f in DEFAULT_TS_FORMATS:
        assert re.match(shape_regex(f).replace(r"\p{L}", "[A-Za-z]"),
                        dt.datetime(2026, 8, 2, 9, 5, 7).strftime(
                            f.replace("yyyy", "%Y").replace("MMM", "%b").replace("MM", "%m")
                             .replace("dd", "%d").replace("HH", "%H").replace("mm", "%M")
                             .replace("ss", "%S")))


def test_map_codes(spark):
    e = map_codes("x", PAYMENT_METHODS, "Other")
    assert [one(spark, e, v) for v in ["cc", "paypal", "giftcard", "CreditCard", None]] == \
        ["Credit Card", "PayPal", "Gift Card", "Other", "Other"]
    for n in (3, 16, 17, 100):                             # the same at every size
        codes = {str(i): None if i == 2 else f"v{i}" for i in range(n)}
        got = [one(spark, map_codes("x", codes, "none"), v) for v in ("1", "2", "x", None)]
        assert got == ["v1", None, "none", "none"]
        assert one(spark, map_codes("x", codes, "none"), 1, "x int") == "v1"


@pytest.mark.parametrize("fmt,text", [("yyyy-MM-dd[ HH:mm:ss]", "2026-08-01 10:00:00"), ("yyyy-MM-dd[ HH:mm:ss]", "2026-08-01"),
                                      ("yyyy-MM-dd G", "2026-08-01 AD"), ("yyyy'T'MM", "2026T08")])
def test_patterns_that_are_not_modelled_are_not_guarded(spark, fmt, text):
    assert shape_regex(fmt) is None
    assert one(spark, parse_ts("x", [fmt]), text) is not None


def test_totals_that_do_not_fit_are_null(spark):
    assert one(spark, items_total(parse_items("x")), "[1:2000000000:9999999999999999.99]") is None
    from strata.operators.items import item_reconciliation
    df = spark.createDataFrame([("1.00", "[1:2000000000:9999999999999999.99]")], "gross_amount string, raw_item_details string")
    assert item_reconciliation(df).first().amount_matches is False


def test_null_tokens(spark):
    assert [one(spark, null_if_token("x"), v) for v in ["NULL", " null ", "", "a"]] == [None, None, None, "a"]


def test_parse_items(spark):
    r = one(spark, parse_items("x"), "[101:2:19.99|105:1:4.99]")
    assert [(i.item_id, i.quantity, str(i.unit_price)) for i in r] == [(101, 2, "19.99"), (105, 1, "4.99")]
    assert one(spark, parse_items("x"), "NULL") is None
    assert one(spark, parse_items("x"), "[]") is None
    assert [tuple(i) for i in one(spark, parse_items("x"), "[x:1:bad]")] == [(None, 1, None)]
    assert str(one(spark, items_total(parse_items("x")), "[101:2:19.99|105:1:4.99]")) == "44.97"
    assert str(one(spark, items_total(parse_items("x")), None)) == "0.00"


FENCE_1 = "````SQL filename=x.sql\n select 1 \n````\ntext\n```yaml\na: 1\n```"
FENCE_2 = "```sql\nselect 2\n```\n```yml\nb: 2\n```"


@pytest.mark.parametrize("text,sql,yaml", [
    (FENCE_1, "select 1", "a: 1"),
    (FENCE_2, "select 2", "select 2"),
    ("\nno fence\n", "no fence", "no fence"),
])
def test_extract_block(spark, text, sql, yaml):
    assert one(spark, extract_block("x", "sql"), text) == sql
    assert one(spark, extract_block("x", "yaml"), text) == yaml


def test_extract_pair(spark):
    from strata.functions.text import extract_pair
    r = one(spark, extract_pair("x"), FENCE_2)
    assert (r.sql, r.yaml) == ("select 2", "select 2")
