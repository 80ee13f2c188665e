"""Plan-shape tests: the scale properties the operators promise."""

from pyspark.sql import functions as F

from strata.operators.dedupe import keep_latest
from strata.operators.joins import join_dimension
from strata.sources.files import spread_input


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _no_auto_broadcast(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    prev_aqe = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    return prev, prev_aqe


def _restore(spark, prev, prev_aqe):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    if prev_aqe is None:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    else:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", prev_aqe)


def test_broadcast_only_within_checked_bound(spark):
    fact = spark.range(0, 5000).selectExpr("id", "id % 50 AS k")
    dim = spark.range(0, 50).selectExpr("id AS k", "concat('n', id) AS name")
    prev = _no_auto_broadcast(spark)
    try:
        small = _plan(join_dimension(fact, dim, "k", "left", max_broadcast_rows=100))
        big = _plan(join_dimension(fact, dim, "k", "left", max_broadcast_rows=10))
    finally:
        _restore(spark, *prev)
    assert "BroadcastHashJoin" in small
    assert "BroadcastHashJoin" not in big and "SortMergeJoin" in big


def test_keep_latest_limits_before_the_shuffle(spark):
    # one key holds a third of the rows
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("ts"))
    out = keep_latest(df.repartition(8), ["k"], ["ts"])
    plan = _plan(out)
    assert plan.count("WindowGroupLimit") >= 2          # partial (map side) + final
    hot = out.where("k = -1").collect()
    assert len(hot) == 1 and hot[0].ts == 29997
    assert out.count() == 20001


def test_spread_input_is_a_noop_on_many_partitions(spark):
    many = spark.range(0, 1000, numPartitions=64)
    assert spread_input(many) is many
    few = spark.range(0, 1000, numPartitions=1)
    assert spread_input(few, min_partitions=4).rdd.getNumPartitions() == 4


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def test_registered_queries_have_no_cross_joins_or_python(spark):
    from strata.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, sf))
        bad = [f for f in FORBIDDEN if f in plan]
        assert not bad, (name, bad)


def test_an_unset_checkpoint_folder_is_an_error_off_local_masters(spark, monkeypatch):
    import pytest

    from strata import session

    class Fake:
        sparkContext = type("C", (), {"master": "yarn", "applicationId": "a", "getConf": lambda s: {}})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Fake())


def test_scratch_can_be_discarded(spark):
    import os

    from strata.session import discard, materialize
    df = materialize(spark.range(10), "gone")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    discard(df)
    assert not os.path.isdir(path)
