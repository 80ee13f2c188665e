"""Keep-latest with state, whole-batch appends, merged folders and published versions."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from strata.operators.dedupe import keep_latest
from strata.sources import sinks as K
from strata.streaming.silver import current, latest_changes, latest_rows, publish_current

KEYS, ORDER = ["k"], ["t"]
DDL = "k int, t timestamp, v string, x double, s struct<a:int,b:string>, l array<int>"


def versions(seed, n=400):
    """Rows with repeated keys, NULL keys, NULL times, ties, exact copies and nested columns."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        t = None if r.random() < .1 else dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(4))
        rows.append((r.choice([None, *range(40)]), t, r.choice("abc"), r.choice([None, 0.0, -0.0, 1.5]),
                     r.choice([None, (1, None), (1, "z"), (None, "q")]), r.choice([None, [], [1], [1, 2]])))
    return rows + rows[:20]


def text(df):
    return sorted(str(r) for r in df.select("k", "t", "v", F.col("x") + 0.0, "s", "l").collect())


def test_latest_as_an_aggregate_equals_the_ranking(spark):
    for seed in range(3):
        df = spark.createDataFrame(versions(seed), DDL)
        assert text(latest_rows(df, KEYS, ORDER)) == text(keep_latest(df, KEYS, ORDER))
    assert latest_rows(df.limit(0), KEYS, ORDER).collect() == []


def test_state_through_late_rows_and_restarts(spark, tmp_dir):
    src, out, ck, root = (os.path.join(tmp_dir, n) for n in ("in", "out", "ck", "root"))
    rows = []
    for run in range(3):
        more = versions(10 + run, 100)
        rows += more
        spark.createDataFrame(more, DDL).coalesce(1).write.mode("append").parquet(src)
        latest_changes(spark.readStream.schema(DDL).parquet(src), out, ck, KEYS, ORDER, compact_after=1)
        want = text(keep_latest(spark.createDataFrame(rows, DDL), KEYS, ORDER))
        assert text(current(spark, out, KEYS, ORDER)) == want
        table = publish_current(spark, out, "strata_test_current", root, KEYS, ORDER)
        assert text(table) == want
    # nothing new: nothing is appended; an older version of a key changes nothing either
    n = K.read_batches(spark, out).count()
    old = [(k, dt.datetime(2000, 1, 1), "zzz", 9.0, (9, "z"), [9]) for k in range(40) if any(r[0] == k and r[1] for r in rows)]
    spark.createDataFrame(old, DDL).coalesce(1).write.mode("append").parquet(src)
    latest_changes(spark.readStream.schema(DDL).parquet(src), out, ck, KEYS, ORDER, compact_after=None)
    assert text(current(spark, out, KEYS, ORDER)) == want and K.read_batches(spark, out).count() <= n + 41
    assert K.read_batches(spark, out).count() < len(rows)  # a change per key and batch at most, not every row
    spark.sql("DROP VIEW strata_test_current")


def append(spark, path, query, number, values):
    K._write_once(spark.createDataFrame([(v,) for v in values], "id long").coalesce(1), path, f"{K.LOAD}={query}-{number}", "parquet", ())


def test_many_batches_leave_few_folders(spark, tmp_dir):
    path = os.path.join(tmp_dir, "rows")
    for i in range(45):
        append(spark, path, "q", i, [2 * i, 2 * i + 1])
        K.compact_batches(spark, path, least=4)
        if i in (7, 20, 44):
            assert sorted(r.id for r in K.read_batches(spark, path).collect()) == list(range(2 * i + 2))
            assert len(K.committed(spark, path)) <= 14
    assert len(K._folders(spark, path, f"{K.LOAD}=")) < 30
    assert f"{K.LOAD}=q-44" in K.committed(spark, path)
    before = K.committed(spark, path)
    append(spark, path, "q", 44, [999])  # the newest batch once more: it is there
    assert K.committed(spark, path) == before and K.read_batches(spark, path).count() == 90


def test_readers_see_one_state(spark, tmp_dir):
    """A frame that is open while folders are merged, a batch is replayed and a version is published."""
    path, root = os.path.join(tmp_dir, "rows"), os.path.join(tmp_dir, "root")
    for i in range(6):
        append(spark, path, "q", i, [i])
    opened = K.read_batches(spark, path)
    first = K.publish(opened, "strata_test_open", root)
    K.compact_batches(spark, path, least=2)
    append(spark, path, "q", 5, [5])
    append(spark, path, "q", 6, [6])
    assert sorted(r.id for r in opened.collect()) == list(range(6))
    assert sorted(r.id for r in K.read_batches(spark, path).collect()) == list(range(7))
    second = K.publish(K.read_batches(spark, path).withColumn("w", F.lit(1)), "strata_test_open", root)
    assert sorted(r.id for r in first.collect()) == list(range(6)) and first.columns == ["id"]
    assert second.columns == ["id", "w"] and spark.table("strata_test_open").count() == 7
    K.publish(spark.range(1), "strata_test_open", root)
    assert K._folders(spark, root, "version=") == ["version=0000000002", "version=0000000003"]
    spark.sql("DROP VIEW strata_test_open")


def test_a_half_written_batch_is_not_read(spark, tmp_dir):
    path = os.path.join(tmp_dir, "rows")
    append(spark, path, "q", 0, [1])
    spark.range(5).write.parquet(f"{path}/{K.ASIDE}/left")  # the writer died before the move
    assert K.read_batches(spark, path).count() == spark.read.parquet(path).count() == 1


def test_append_to_a_named_table_in_another_format(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    spark.range(10).repartition(2).write.parquet(src)
    name = f"strata_test_appended_{random.randrange(10 ** 9)}"
    K.append_batches(spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(src), name, os.path.join(tmp_dir, "ck"), fmt="orc")
    assert sorted(r.id for r in spark.table(name).collect()) == list(range(10))
    assert K.read_batches(spark, name, "orc").count() == 10
    spark.sql(f"DROP VIEW {name}")
