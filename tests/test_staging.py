"""Staged files and the state of streams follow the size of their input."""
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from strata.plans import streams
from strata.streaming.silver import STATE, latest_changes, latest_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(monkeypatch, tmp_path):
    """Where the query of a test stages; files of 200 rows."""
    monkeypatch.setattr(streams, "STAGED", 200)
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex[:12]}")
    return lambda name: sorted(glob.glob(f"{tmp_path}/{name}-*"), key=len)[0]


def files(path: str) -> int:
    return len(glob.glob(f"{path}/part-*"))


def test_silver_stream_stages_files_by_rows(spark, folder):
    streams.q_silver_stream(spark, SF)
    assert files(folder("lineitem-in")) >= spark.read.parquet(f"{SF}/lineitem.parquet").count() // 200
    assert len(glob.glob(f"{folder('silver-rows')}/_load=*")) == 4


def test_ecommerce_chain_stages_files_by_rows(spark, folder):
    streams.q_ecommerce_chain(spark, SF)
    assert files(folder("events")) >= spark.read.parquet(f"{SF}/orders.parquet").count() // 200


def test_transactions_stream_stages_files_by_rows(spark, folder):
    streams.q_transactions_stream(spark, SF)
    rows = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 29 <> 0").count()
    assert files(folder("tx-bronze")) >= rows // 200
    assert len(glob.glob(f"{folder('tx-rows')}/_load=*")) == 7


def test_silver_state_keeps_its_number_of_batches(spark, folder):
    streams.q_silver_state(spark, SF)
    commits = f"{folder('ckpt')}/commits"
    assert files(folder("lineitem-in")) > 6
    assert sum(n.isdigit() for n in os.listdir(commits)) <= 8


def test_state_is_stored_on_disk_and_rows_once(spark, tmp_dir):
    df = spark.createDataFrame([(1, 2, "a", None), (1, 2, "b", None), (1, None, "z", 5.0), (None, 1, None, 1.0)], "k int, t int, v string, w double")
    assert sorted(map(str, latest_rows(df, ["k"], ["t"]).collect())) == ["Row(k=1, t=2, v='b', w=None)", "Row(k=None, t=1, v=None, w=1.0)"]
    assert "max_by" not in latest_rows(df, ["k"], ["t"])._jdf.queryExecution().optimizedPlan().toString()
    maps = df.withColumn("m", F.create_map("v", "t"))
    assert {r.m["b"] for r in latest_rows(maps.where("k = 1"), ["k"], ["t"]).collect()} == {2}
    df.write.parquet(f"{tmp_dir}/in")
    latest_changes(spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/in"), f"{tmp_dir}/out", f"{tmp_dir}/ckpt", ["k"], ["t"])
    key = "spark.sql.streaming.stateStore.providerClass"
    offsets = open(f"{tmp_dir}/ckpt/offsets/0").read()
    assert STATE[key] in offsets and spark.conf.get(key, "") == ""


def test_state_holds_keys_once_and_logs_changes(spark, tmp_dir):
    df = spark.createDataFrame([(1, 0.0, 2, "a"), (1, -0.0, 3, "b"), (2, None, 1, "c")], "k int, f double, t int, v string")
    rows = latest_rows(df, ["k", "f"], ["t"])
    assert sorted(map(str, rows.collect())) == ["Row(k=1, f=-0.0, t=3, v='b')", "Row(k=2, f=None, t=1, v='c')"]
    # a whole-number key is the group's; a float is not, as 0.0 and -0.0 are one group
    held = rows._jdf.queryExecution().analyzed().toString().split("max(struct(")[1].split(")")[0]
    assert "f, f#" in held and "k, k#" not in held
    df.write.parquet(f"{tmp_dir}/in")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = shuffled()
    latest_changes(spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/in"), f"{tmp_dir}/out", f"{tmp_dir}/ckpt", ["k", "f"], ["t"])
    assert shuffled() <= before
    assert glob.glob(f"{tmp_dir}/ckpt/state/0/*/1.changelog") and not glob.glob(f"{tmp_dir}/ckpt/state/0/*/*.zip")
    assert sorted(map(str, spark.read.parquet(f"{tmp_dir}/out").select(*df.columns).collect())) == sorted(map(str, rows.collect()))
