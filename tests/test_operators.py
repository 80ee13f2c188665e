import datetime as dt

from pyspark.sql import functions as F

from strata.operators.conform import (fill_defaults, normalize_case_columns, rename, snake_case,
                                      snake_case_columns, trim_strings, with_code_map)
from strata.operators.dedupe import keep_latest
from strata.operators.gold import active_users, monthly_recurring_revenue
from strata.operators.joins import (build_star, combine_accounts, fits_broadcast, join_dimension,
                                    orphans)
from strata.operators.quality import (TestSuite, accepted_values, describe_model, failing_rows,
                                      not_null, relationships, run_tests, split_valid, unique)
from strata.operators.windows import rolling_days, rolling_rows


def test_snake_case():
    assert [snake_case(x) for x in ["CUST_ID", "custId", "Cust ID", "OPEN_DT", "HTTPStatus"]] == \
        ["cust_id", "cust_id", "cust_id", "open_dt", "http_status"]


def test_conform_helpers(spark):
    df = spark.createDataFrame([(" a ", None, "x")], "CustName string, Amt decimal(18,2), p string")
    out = snake_case_columns(df, {"Amt": "gross_amount"})
    assert out.columns == ["cust_name", "gross_amount", "p"]
    out = fill_defaults(trim_strings(out), {"gross_amount": 0})
    out = with_code_map(out, "p", {"x": "X-ray"}, "Other", out="p_word", keep_raw_as="p_raw")
    out = normalize_case_columns(rename(out, {"cust_name": "name"}), {"name": None})
    r = out.first()
    assert (r.name, str(r.gross_amount), r.p_word, r.p_raw) == ("A", "0.00", "X-ray", "x")
    assert dict(out.dtypes)["gross_amount"] == "decimal(18,2)"


def test_keep_latest_total_and_idempotent(spark):
    rows = [("k", dt.datetime(2026, 1, 2), 1), ("k", dt.datetime(2026, 1, 2), 2),
            ("k", None, 3), ("j", None, 4)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, v int")
    a = keep_latest(df, ["key"], ["ts"]).orderBy("key").collect()
    b = keep_latest(df.orderBy(F.rand(7)).repartition(3), ["key"], ["ts"]).orderBy("key").collect()
    assert a == b
    assert [r.v for r in a] == [4, a[1].v] and a[1].ts is not None
    again = keep_latest(keep_latest(df, ["key"], ["ts"]), ["key"], ["ts"]).orderBy("key").collect()
    assert again == a


def test_rolling_gap(spark):
    df = spark.createDataFrame([(dt.date(2026, 8, 1), 4), (dt.date(2026, 8, 2), 2), (dt.date(2026, 8, 10), 6)],
                               "d date, n bigint")
    rows = rolling_days(rolling_rows(df, "n", "d", 7, out="w2"), "n", "d", 7, out="w3").orderBy("d").collect()
    assert [(r.w2, r.w3) for r in rows] == [(4.0, 4.0), (3.0, 3.0), (4.0, 6.0)]


def test_joins(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", "A")], "k string, name string")
    assert fits_broadcast(dim, 1) and not fits_broadcast(fact, 2)
    j = join_dimension(fact, dim, "k", "left").orderBy("id").collect()
    assert [r.name for r in j] == ["A", None, None]
    assert [r.id for r in orphans(fact, dim, "k", "k").collect()] == [2]
    star, dims = build_star(fact, {"thing": (dim, "k", "k")})
    assert "sk_thing" in star.columns and "k" not in star.columns
    assert star.join(dims["thing"], "sk_thing").count() == 1


def test_combine_accounts(spark):
    df = spark.createDataFrame([("c1", "Savings", 10), ("c1", "Checking", 5), ("c2", "Savings", 1)],
                               "c string, t string, b int")
    r = {x.c: x for x in combine_accounts(df, "c", "t", "b", ["Savings", "Checking", "CD"]).collect()}
    assert (r["c1"].Savings, r["c1"].Checking, r["c1"].CD) == (10, 5, None)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, None, "y"), (2, "b", "zz"), (None, "c", "x")],
                               "id int, s string, v string")
    parent = spark.createDataFrame([("a",), ("b",)], "s string")
    assert {r.column_name: r.failures for r in not_null(df, ["id", "s"]).collect()} == {"id": 1, "s": 1}
    assert unique(df, "id").first().failures == 1
    assert accepted_values(df, "v", ["x", "y"]).first().failures == 1
    assert relationships(df, "s", parent, "s").first().failures == 1
    suite = TestSuite("m", not_null=["id"], unique=["id"], accepted_values={"v": ["x", "y"]},
                      relationships={"s": (parent, "s")})
    res = run_tests(df, suite)
    assert res.columns == ["model", "column_name", "test", "failures"] and res.count() == 4
    assert sorted((r.id or 0, r.v, tuple(r._failed_tests)) for r in failing_rows(df, suite).collect()) == [
        (0, "x", ("not_null:id", "relationships:s")), (1, "x", ("unique:id",)), (1, "y", ("unique:id",)), (2, "zz", ("accepted_values:v",))]
    valid, quarantine = split_valid(df, ["id"], {"short_v": F.length("v") < 2})
    assert valid.count() == 2
    assert sorted(r._reject_reason for r in quarantine.collect()) == ["missing:id", "short_v"]
    described = describe_model(df, {"id": "the key"})
    assert described.schema["id"].metadata["comment"] == "the key"


def test_keys_of_other_types_and_signed_zeros(spark):
    """Under ANSI a parent that the child's type can't hold is no match, and no error; 0.0 and -0.0 are one value."""
    child = spark.createDataFrame([(1,), (2,), (None,), (7,)], "k int")
    for values, ddl, failures in ((["1", "abc", "7"], "string", 1), ([5_000_000_000, 1], "long", 2), ([1.0, 2.5, 7.0], "double", 1)):
        parent = spark.createDataFrame([(v,) for v in values], f"p {ddl}")
        assert relationships(child, "k", parent, "p").first().failures == failures
        suite = TestSuite("m", relationships={"k": (parent, "p")})
        assert run_tests(child, suite).first().failures == failures == failing_rows(child, suite).count()
    floats = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (float("nan"),), (float("nan"),)], "x double")
    suite = TestSuite("m", unique=["x"])
    assert unique(floats, "x").first().failures == run_tests(floats, suite).first().failures == 2
    assert failing_rows(floats, suite).count() == 4


def test_failing_rows_of_a_hot_key(spark):
    """A third of all rows hold one failing key: every row comes back, and no task gets them all."""
    n = 30_000
    df = spark.range(n).selectExpr("id", "IF(id % 3 = 0, -1, id) AS k")
    parent = spark.range(n).selectExpr("id AS p")
    out = failing_rows(df, TestSuite("m", not_null=["k"], unique=["k"], relationships={"k": (parent, "p")}))
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        rows = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < len(rows) / 3
    assert sorted(r.id for r in rows) == list(range(0, n, 3)) and {tuple(r._failed_tests) for r in rows} == {("unique:k", "relationships:k")}
    assert failing_rows(df.limit(0), TestSuite("m", unique=["k"])).collect() == []


def test_failing_values_are_not_broadcast(spark):
    """Values that fail, however many, reach no driver: only bits of their slots are broadcast."""
    df = spark.range(200_000).selectExpr("id", "id div 2 AS k")
    out = failing_rows(df, TestSuite("m", unique=["k"]))
    assert out.count() == 200_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_dq_k" in x]
    assert "SortMergeJoin" in plan


def test_active_users_and_mrr(spark):
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), 1), (dt.datetime(2024, 1, 1, 2), 1),
                                (dt.datetime(2024, 1, 2), 2), (dt.datetime(2024, 1, 8), 1)],
                               "ts timestamp, user_id int")
    d = {str(r.period_start): r.active_users for r in active_users(ev, "day").collect()}
    w = {str(r.period_start): r.active_users for r in active_users(ev, "week").collect()}
    assert d == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-08": 1}
    assert w == {"2024-01-01": 2, "2024-01-08": 1}
    tx = spark.createDataFrame([("a", dt.datetime(2024, 1, 5), 10), ("a", dt.datetime(2024, 2, 5), 20),
                                ("b", dt.datetime(2024, 1, 5), 5), ("b", dt.datetime(2024, 3, 5), 7)],
                               "customer_id string, transaction_timestamp timestamp, gross_amount int")
    m = [(str(r.month), r.recurring_customers, r.recurring_revenue)
         for r in monthly_recurring_revenue(tx).collect()]
    assert m == [("2024-02-01", 1, 20)]


def test_superseded(spark):
    from strata.operators.dedupe import superseded
    rows = [("k", 1, "a"), ("k", 1, "a"), ("k", 2, "b"), ("j", None, "c"), ("j", None, "c")]
    df = spark.createDataFrame(rows, "key string, ts int, v string")
    sup = sorted(map(tuple, superseded(df, ["key"], ["ts"]).collect()), key=repr)
    assert sup == sorted([("k", 1, "a"), ("k", 1, "a"), ("j", None, "c")], key=repr)


def test_keep_latest_ranks_nested_columns(spark):
    df = spark.createDataFrame([(1, [1, 2], (1, "a")), (1, [1, 3], (0, "z")), (1, [1, 3], (2, "b"))],
                               "k int, a array<int>, s struct<x:int,y:string>")
    for seed in range(3):
        r = keep_latest(df.orderBy(F.rand(seed)).repartition(3), ["k"], []).first()
        assert (r.a, tuple(r.s)) == ([1, 3], (2, "b"))


def test_null_keys_are_spread_and_kept(spark):
    from strata.operators.joins import join_nullable, lookup_category
    items = spark.range(0, 300).selectExpr("id", "if(id % 2 = 0, null, id % 7) AS item_id")
    dim = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "item_id long, category string")
    for bound in (100, None):
        got = lookup_category(items, dim, max_broadcast_rows=bound)
        assert got.columns == ["id", "item_id", "category"] and got.count() == 300
        n = {r.category: r["count"] for r in got.groupBy("category").count().collect()}
        want = [i for i in range(300) if i % 2]
        assert n == {"one": sum(i % 7 == 1 for i in want), "two": sum(i % 7 == 2 for i in want),
                     "Unknown": 300 - sum(i % 7 in (1, 2) for i in want)}
    d = dim.withColumnRenamed("item_id", "k")
    plan = join_nullable(items, d, "item_id", "k", None)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "_salt_0" in plan


def test_several_accepted_values_plan_no_expand(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z"), ("c", "z")], "p string, q string")
    res = run_tests(df, TestSuite("m", accepted_values={"p": ["a"], "q": ["x"]}, unique=["p"]))
    assert {(r.column_name, r.test): r.failures for r in res.collect()} == {
        ("p", "accepted_values"): 2, ("q", "accepted_values"): 1, ("p", "unique"): 1}
    assert "Expand" not in res._jdf.queryExecution().executedPlan().toString()


def test_reconcile_by_content(spark):
    from strata.operators.quality import reconcile
    ddl = "_source_file string, a string, b double"
    frame = lambda *rows: spark.createDataFrame(list(rows), ddl)
    source = frame(("whole", None, 1.0), ("whole", "x", None), ("whole", "x", None), ("moved", None, 1.0), ("moved", "y", 2.0),
                   ("null", None, 1.0), ("twice", "p", 0.0), ("twice", "q", 0.0), ("lost", "z", 1.0), (None, "n", 1.0))
    kept = frame(("whole", "x", None), ("whole", None, 1.0), ("moved", "y", 1.0), ("null", "", 1.0), ("twice", "p", 0.0),
                 (None, "n", 1.0))
    gone = frame(("whole", "x", None), ("moved", None, 2.0), ("twice", "p", 0.0))
    rows = reconcile({"rows_in": source, "kept": kept, "superseded": gone}, content=("a", "b")).collect()
    got = {r["_source_file"]: (r["balanced"], r["content_balanced"]) for r in rows}
    assert got == {"whole": (True, True), "moved": (True, False), "null": (True, False), "twice": (True, False),
                   "lost": (False, False), None: (True, True)}
    assert reconcile({"rows_in": source.limit(0), "kept": kept.limit(0)}, content=("a",)).count() == 0
