"""Tables in the shared scratch folder."""
import glob
import os

from pyspark.sql import functions as F

from strata.session import CLEANUP, materialize


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    """Not only when the driver collects its garbage."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    sizes = lambda: {f: os.path.getsize(f) for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = sizes()
    df = spark.range(300_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.sum("id").alias("v"))
    out = materialize(df, "sums")
    assert not {f: n for f, n in sizes().items() if f not in before and n > 10_000}
    assert out.count() == 50_000 and materialize(df, "sums").count() == 50_000
    assert all(spark.conf.get(k) != v for k, v in CLEANUP.items())  # the session's own statements are left alone


def test_parts_lie_in_folders(spark):
    df = spark.range(100).withColumn("part", (F.col("id") % 3).cast("int"))
    out = materialize(df, "parts", partition_by=["part"])
    assert out.schema["part"].dataType == df.schema["part"].dataType
    assert sorted(r.id for r in out.where("part = 1").collect()) == list(range(1, 100, 3))
    assert materialize(df.limit(0), "none", partition_by=["part"]).count() == 0
