import os

from pyspark.sql import functions as F

import pytest

from strata.sources.files import declare_or_infer_schema
from strata.sources.rescue import rescue_columns, rescue_json
from strata.sources.sinks import read_batches
from strata.streaming.bronze import BronzeConfig, bronze_batch, bronze_stream

JSON_LINES = ['{"k":1,"v":"a"}', '{"k":2,"v":"b","new":{"z":1}}', '{"k":"bad","v":"c"}', '{oops']


def test_rescue_json(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(JSON_LINES)], "id int, value string")
    out = rescue_json(df, {"k": "int", "v": "string"}).orderBy("id").collect()
    got = [(r.k, r.v, r._rescued_data) for r in out]
    assert got == [
        (1, "a", None),
        (2, "b", '{"new":"{\\"z\\":1}"}'),
        (None, "c", '{"k":"bad"}'),
        (None, None, "{oops"),
    ]


CSV = "k,ts,v\nA,2026/08/01,1\nB,bad,x\nA,2026/08/02,3,extra\n"
EXPECTED = {"k": "string", "ts": "timestamp:yyyy/MM/dd", "v": "int"}


def test_rescue_csv_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "csv")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(CSV)
    raw = bronze_batch(spark, BronzeConfig(src, "", "", expected=EXPECTED))
    rows = raw.orderBy("k", F.col("ts").asc_nulls_first()).collect()
    got = [(r.k, None if r.ts is None else r.ts.strftime("%Y-%m-%d"), r.v, r._rescued_data) for r in rows]
    assert got == [
        ("A", "2026-08-01", 1, None),
        ("A", "2026-08-02", 3, "A,2026/08/02,3,extra"),
        ("B", None, None, '{"ts":"bad","v":"x"}'),
    ]


def test_bronze_stream_restart(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(CSV)
    cfg = BronzeConfig(source_path=src, target_path=os.path.join(tmp_dir, "bronze"),
                       checkpoint=os.path.join(tmp_dir, "ckpt"), fmt="csv",
                       columns=["k", "ts", "v"], expected=EXPECTED)
    bronze_stream(spark, cfg)
    first = spark.read.parquet(cfg.target_path)
    assert first.count() == 3
    assert set(first.columns) >= {"_rescued_data", "_ingested_at", "_source_file", "_ingest_date"}
    assert first.where(F.col("_source_file").endswith("a.csv")).count() == 3
    assert any("/_ingest_date=" in f for f in first.inputFiles())   # D17 layout
    bronze_stream(spark, cfg)                       # restart: nothing new
    assert spark.read.parquet(cfg.target_path).count() == 3
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write("k,ts,v\nC,2026/08/03,5\n")
    bronze_stream(spark, cfg)                       # only the new file
    assert spark.read.parquet(cfg.target_path).count() == 4


def test_json_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "json")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(JSON_LINES) + "\n")
    cfg = BronzeConfig(source_path=src, target_path=os.path.join(tmp_dir, "bronze"),
                       checkpoint=os.path.join(tmp_dir, "ckpt"), fmt="json",
                       expected={"k": "int", "v": "string"})
    bronze_stream(spark, cfg)
    rows = spark.read.parquet(cfg.target_path).collect()
    assert len(rows) == 4
    assert sorted(r._rescued_data or "" for r in rows) == sorted(
        ["", "", '{"new":"{\\"z\\":1}"}', '{"k":"bad"}', "{oops"][1:])


def test_declare_or_infer_schema(spark, tmp_dir):
    src = os.path.join(tmp_dir, "csv")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(CSV)
    stored = os.path.join(tmp_dir, "schema")
    s1 = declare_or_infer_schema(spark, "csv", src, stored)
    assert s1.fieldNames() == ["k", "ts", "v"]
    with open(os.path.join(src, "b.csv"), "w") as f:   # drift: a new column
        f.write("k,ts,v,extra\nA,2026/08/01,1,z\n")
    s2 = declare_or_infer_schema(spark, "csv", src, stored)
    assert s2 == s1                                    # remembered, not re-inferred


def test_rescue_json_repeated_key_keeps_record(spark):
    df = spark.createDataFrame([(1, '{"k":1,"k":2}')], "id int, value string")
    r = rescue_json(df, {"k": "int"}).first()
    assert r._rescued_data == '{"k":1,"k":2}'


def test_csv_new_column_does_not_stop_the_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("k,ts,v\nA,2026/08/01,1\n")
    cfg = BronzeConfig(source_path=src, target_path=os.path.join(tmp_dir, "bronze"),
                       checkpoint=os.path.join(tmp_dir, "ckpt"), fmt="csv",
                       columns=["k", "ts", "v"], expected=EXPECTED)
    bronze_stream(spark, cfg)
    with open(os.path.join(src, "b.csv"), "w") as f:          # the source adds a column
        f.write("k,ts,v,extra\nB,2026/08/02,2,zz\n")
    bronze_stream(spark, cfg)
    rows = {r.k: r for r in spark.read.parquet(cfg.target_path).collect()}
    assert rows["B"].v == 2 and rows["B"].ts is not None
    assert rows["B"]._rescued_data == '{"extra":"zz"}'
    assert rows["A"]._rescued_data is None


def test_reordered_header_goes_by_name(spark, tmp_dir):
    src = os.path.join(tmp_dir, "csv dir")
    os.makedirs(src)
    for name, text in (("a.csv", "v,ts,k\n1,2026/08/01,A\n"), ("b.csv", "k,v\n\"B, b\",2\n"), ("c.csv", ""),
                       ("d.txt", "k,v\nD,4\n")):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    rows = {r.k: r for r in bronze_batch(spark, BronzeConfig(src, "", "", expected=EXPECTED)).collect()}
    assert set(rows) == {"A", "B, b"}
    assert (rows["A"].v, str(rows["A"].ts)[:10], rows["A"]._rescued_data) == (1, "2026-08-01", None)
    assert (rows["B, b"].v, rows["B, b"].ts, rows["B, b"]._rescued_data) == (2, None, None)


def test_rounding_is_a_misfit(spark):
    df = spark.createDataFrame([("12.349",), ("12.30",), ("12.300",), ("1e2",), ("x",)], "a string")
    got = [(None if r.a is None else str(r.a), r._rescued_data) for r in rescue_columns(df, {"a": "decimal(18,2)"}).collect()]
    assert got == [(None, '{"a":"12.349"}'), ("12.30", None), ("12.30", None), ("100.00", None), (None, '{"a":"x"}')]


def test_rescue_keeps_old_and_new(spark):
    df = spark.createDataFrame([("x", '{"b":"1"}', "e"), ("1", '{"b":"1"}', None), ("x", None, None)],
                               "a string, _rescued_data string, extra string")
    got = [r._rescued_data for r in rescue_columns(df, {"a": "int"}, undeclared=["extra"]).collect()]
    assert got == ['{"b":"1","a":"x","extra":"e"}', '{"b":"1"}', '{"a":"x"}']


def test_json_schema_comes_from_all_rows(spark, tmp_dir):
    src = os.path.join(tmp_dir, "json")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('{"k":1}\n{"k":2,"late":"x"}\n{"k":3}\n')
    assert declare_or_infer_schema(spark, "json", src, os.path.join(tmp_dir, "s")).fieldNames() == ["k", "late"]
    os.makedirs(src + "2")
    with open(os.path.join(src + "2", "a.json"), "w") as f:
        f.write("{oops\n")
    with pytest.raises(ValueError):
        declare_or_infer_schema(spark, "json", src + "2", os.path.join(tmp_dir, "s2"))


def test_parquet_type_drift_is_rescued(spark, tmp_dir):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    src = os.path.join(tmp_dir, "p")
    spark.createDataFrame([(1, "a")], "k long, v string").write.mode("append").parquet(src)
    spark.createDataFrame([("2", "b", [1]), ("z", "c", None)], "k string, v string, more array<int>").write.mode("append").parquet(src)
    cfg = BronzeConfig(src, os.path.join(tmp_dir, "b"), os.path.join(tmp_dir, "c"), fmt="parquet",
                       schema=StructType([StructField("k", LongType()), StructField("v", StringType())]))
    bronze_stream(spark, cfg)
    want = {("a", 1, None), ("b", 2, '{"more":"[1]"}'), ("c", None, '{"k":"z"}')}
    for df in (read_batches(spark, cfg.target_path), bronze_batch(spark, cfg)):
        assert {(r.v, r.k, r._rescued_data) for r in df.collect()} == want


def test_metadata_errors_are_not_swallowed(spark, tmp_dir):
    from strata.sources.metadata import with_ingest_metadata
    plain = with_ingest_metadata(spark.range(1)).first()
    assert plain._source_file is None and plain._ingest_date is not None
