import os

from pyspark.sql import functions as F

from fixtures import write_csv
from strata.plans.ecommerce import (RAW_COLUMNS, silver_transactions, stream_bronze_transactions,
                                    stream_silver_transactions, transactions_snapshot)
from strata.sources.files import read_table
from strata.sources.sinks import append_batches, materialize_gold, read_batches, write_overwrite
from strata.streaming.bronze import BronzeConfig, bronze_stream
from strata.streaming.silver import snapshot


def test_silver_stream_equals_batch(spark, tmp_dir):
    src, bronze, rows = (os.path.join(tmp_dir, n) for n in ("raw", "bronze", "rows"))
    write_csv(src)
    stream_bronze_transactions(spark, src, bronze, os.path.join(tmp_dir, "cb"))
    stream_silver_transactions(spark, bronze, rows, os.path.join(tmp_dir, "cs"))
    first, _ = transactions_snapshot(spark, rows, os.path.join(tmp_dir, "silver"))
    before = first.collect()
    # a second file arrives later: a newer version of O-9984, a new order and a row without a key
    write_csv(src, "late.csv", ",".join(reversed(RAW_COLUMNS)) + "\n"
                               "cc,COMPLETED,0.08,5.00,,2026-08-03 10:00:00,C_1082,O-9984\n"
                               "paypal,COMPLETED,0.08,19.99,[101:1:19.99],2026-08-07,C_1,O-9990\n"
                               "paypal,COMPLETED,0.08,1.00,,2026-08-07,C_1,\n")
    stream_bronze_transactions(spark, src, bronze, os.path.join(tmp_dir, "cb"))
    stream_silver_transactions(spark, bronze, rows, os.path.join(tmp_dir, "cs"))
    # another checkpoint appends everything again
    stream_silver_transactions(spark, bronze, rows, os.path.join(tmp_dir, "other"))
    valid, quarantine = transactions_snapshot(spark, rows, os.path.join(tmp_dir, "silver"))
    want, rejected = silver_transactions(read_batches(spark, bronze))
    cols = ["order_id", "transaction_timestamp", "gross_amount", "order_status"]
    assert sorted(map(tuple, valid.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {r.order_id for r in quarantine.collect()} == {r.order_id for r in rejected.collect()} == {"O-9989", None}
    r = valid.where("order_id = 'O-9984'").first()
    assert str(r.gross_amount) == "5.00" and r.order_status == "COMPLETED"
    assert first.collect() == before                      # older snapshots stay as they were


def test_a_replayed_batch_counts_once(spark, tmp_dir):
    src, rows, ck = (os.path.join(tmp_dir, n) for n in ("in", "rows", "ck"))
    spark.range(0, 100).repartition(2).write.parquet(src)

    def run():
        append_batches(spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(src), rows, ck)

    run()
    commits = os.path.join(ck, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):                       # the last batch's commit never happened
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    run()
    assert sorted(r.id for r in read_batches(spark, rows).collect()) == list(range(100))
    # a query with another checkpoint on the same folder loses and overwrites nothing
    append_batches(spark.readStream.schema("id long").parquet(src), rows, ck + "2")
    assert read_batches(spark, rows).count() == 200


def test_unreadable_rows_are_an_error(spark, tmp_dir):
    import pytest
    rows = os.path.join(tmp_dir, "rows")
    snapshot(spark.range(10), rows)
    part = next(os.path.join(d, f) for d, _, names in os.walk(rows) for f in names if f.endswith(".parquet"))
    with open(part, "wb") as f:
        f.write(b"broken")
    with pytest.raises(Exception):
        transactions_snapshot(spark, rows, os.path.join(tmp_dir, "s"))


def test_a_stream_can_run_on(spark, tmp_dir):
    import time
    src = os.path.join(tmp_dir, "in")
    write_csv(src)
    cfg = BronzeConfig(src, os.path.join(tmp_dir, "b"), os.path.join(tmp_dir, "c"), columns=RAW_COLUMNS, available_now=False)
    q = bronze_stream(spark, cfg)
    try:
        q.processAllAvailable()
        n = read_batches(spark, cfg.target_path).count()
        write_csv(src, "more.csv", ",".join(RAW_COLUMNS) + "\nO-1,C,2026-08-01,,1,0.1,x,cc\n")
        end = time.time() + 60
        while read_batches(spark, cfg.target_path).count() == n and time.time() < end:
            q.processAllAvailable()
        assert q.isActive and read_batches(spark, cfg.target_path).count() == n + 1
    finally:
        q.stop()


def test_sinks_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = os.path.join(tmp_dir, "t")
    write_overwrite(df, path, partition_by=["v"])
    assert read_table(spark, path).count() == 2
    write_overwrite(df.where("id = 1").withColumn("w", F.lit(1)), path)   # schema replaced
    back = read_table(spark, path)
    assert back.count() == 1 and "w" in back.columns
    # a partitioned overwrite with fewer partitions keeps none of the old ones
    write_overwrite(df, path + "2", partition_by=["v"])
    write_overwrite(df.where("id = 2"), path + "2", partition_by=["v"])
    assert [tuple(r) for r in read_table(spark, path + "2").collect()] == [(2, "b")]
    g = materialize_gold(df.groupBy("v").count(), os.path.join(tmp_dir, "gold"))
    assert g.count() == 2
    v = materialize_gold(df, "gold_view", view_only=True)
    assert spark.table("gold_view").count() == v.count() == 2


def test_bucketed_tables_join_without_shuffle(spark):
    orders = spark.range(0, 2000).selectExpr("id AS k", "id % 7 AS v")
    items = spark.range(0, 6000).selectExpr("id % 2000 AS k", "id AS w")
    write_overwrite(orders, "strata_test_orders_b", bucket_by=(4, ["k"]))
    write_overwrite(items, "strata_test_items_b", bucket_by=(4, ["k"]))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("strata_test_items_b").join(spark.table("strata_test_orders_b"), "k")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 6000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.sql("DROP TABLE IF EXISTS strata_test_orders_b")
        spark.sql("DROP TABLE IF EXISTS strata_test_items_b")
