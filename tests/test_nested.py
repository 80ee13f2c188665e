"""Nested values, layouts and names in bronze loads."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.sources.layouts import csv_layouts, parquet_layouts
from strata.sources.rescue import rescue_columns, rescue_json
from strata.sources.sinks import read_batches
from strata.streaming.bronze import BronzeConfig, bronze_batch, bronze_stream

DDL = "id int, a struct<x:int,y:array<int>,z:struct<d:date>>, m map<string,double>, l array<struct<q:decimal(5,2)>>, v variant"


def plain_fit(v, t, path, out):
    """What a declared type takes of a parsed JSON value; misfits go to ``out``."""
    kind = t.typeName()
    text = v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True)
    if v is None:
        return None
    if kind == "struct":
        if not isinstance(v, dict):
            out[path] = text
            return None
        for k in v:
            if k not in t.fieldNames():
                inner = v[k]
                out[f"{path}.{k}"] = inner if isinstance(inner, str) or inner is None else json.dumps(inner, separators=(",", ":"), sort_keys=True)
        return {f.name: plain_fit(v.get(f.name), f.dataType, f"{path}.{f.name}", out) for f in t}
    if kind == "array":
        if not isinstance(v, list):
            out[path] = text
            return None
        return [plain_fit(x, t.elementType, f"{path}[{i}]", out) for i, x in enumerate(v)]
    if kind == "map":
        if not isinstance(v, dict):
            out[path] = text
            return None
        return {k: plain_fit(x, t.valueType, f"{path}.{k}", out) for k, x in v.items()}
    try:
        return {"integer": int, "double": float}[kind](text)
    except ValueError:
        out[path] = text
        return None


def test_random_values_against_a_plain_fit(spark):
    r = random.Random(2)

    def value(depth):
        k = r.randrange(9)
        if depth and k < 3:
            return {c: value(depth - 1) for c in r.sample("xyzk", r.randint(0, 3))}
        if depth and k < 6:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        return r.choice([1, -7, "12", "no", None, True, "", " 3 "])

    t = StructType.fromDDL("a struct<x:int,y:array<struct<x:int>>,z:map<string,array<int>>>")["a"].dataType
    data = [(i, {"a": value(4)}) for i in range(400)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in data], "i int, value string")
    got = {x.i: x for x in rescue_json(df, {"a": t}).collect()}
    for i, x in data:
        out = {}
        want = plain_fit(x["a"], t, "$.a", out)
        if "$.a" in out:
            out["a"] = out.pop("$.a")
        assert (got[i].a and got[i].a.asDict(True)) == want, (x, got[i])
        assert json.loads(got[i]._rescued_data or "{}") == out, (x, got[i])
    columns = df.select("i", F.get_json_object("value", "$.a").alias("a"))
    for x in rescue_columns(columns.where("a like '{%'"), {"a": t}).collect():
        assert (x.a, x._rescued_data) == (got[x.i].a, got[x.i]._rescued_data)


def test_leaves_and_odd_names(spark):
    lines = ['{"id":1,"a":{"x":1,"y":[1,"b"],"z":{"d":"2024-02-30"}},"m":{"p":1,"q.r":"zz"},"l":[{"q":1.234},{"q":"2.50"}],"v":{"any":[1]}}',
             '{"id":2,"a":{"x":1,"x":2},"m":{}}', '{"id":3,"a":[1],"m":"t","l":null}', '{oops', None, '[1]']
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    rows = rescue_json(df, {f.name: f.dataType for f in StructType.fromDDL(DDL)}).collect()
    r = rows[0]
    assert r.a.asDict(True) == {"x": 1, "y": [1, None], "z": {"d": None}} and r.m == {"p": 1.0, "q.r": None}
    assert [None if x.q is None else str(x.q) for x in r.l] == [None, "2.50"]
    assert json.loads(r._rescued_data) == {"$.a.y[1]": "b", "$.a.z.d": "2024-02-30", '$.m["q.r"]': "zz", "$.l[0].q": "1.234"}
    assert json.loads(rows[1]._rescued_data) == {"a": '{"x":1,"x":2}', "m": "{}"} and rows[1].id == 2  # not parsed: a name twice
    assert json.loads(rows[2]._rescued_data) == {"a": "[1]", "m": "t"} and rows[2].l is None
    assert [x._rescued_data for x in rows[3:]] == ["{oops", None, "[1]"]


def test_map_keys_must_be_text(spark):
    with pytest.raises(ValueError):
        rescue_json(spark.createDataFrame([("{}",)], "value string"), {"m": "map<int,int>"})


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def load(spark, tmp_dir, **more):
    """Batch and stream of the same files, which must agree; the rows without ingest metadata."""
    cfg = BronzeConfig(**{"source_path": os.path.join(tmp_dir, "in"), "target_path": os.path.join(tmp_dir, "out"),
                          "checkpoint": os.path.join(tmp_dir, "ck"), "layouts_at": os.path.join(tmp_dir, "layouts"), **more})
    bronze_stream(spark, cfg)
    plain = lambda df: sorted(map(str, df.drop("_source_file", "_ingested_at", "_ingest_date").collect()))
    batch = bronze_batch(spark, cfg)
    assert plain(read_batches(spark, cfg.target_path)) == plain(batch)
    return batch.collect()


def test_line_breaks_in_quotes(spark, tmp_dir):
    write(f"{tmp_dir}/in", "a.csv", 'id,text\n1,"two\nlines, ""quoted"""\n2,plain\n')
    write(f"{tmp_dir}/in", "b.csv", 'id,text\n3,"5"" pipe"\n4,x\n')
    write(f"{tmp_dir}/in", "c.csv", '"id","te\nxt",text\n5,a,b\n')
    rows = {r.id: r for r in load(spark, tmp_dir, expected={"id": "int", "text": "string"}, escape='"')}
    assert {i: (r.text, r._rescued_data) for i, r in rows.items()} == {
        1: ('two\nlines, "quoted"', None), 2: ("plain", None), 3: ('5" pipe', None), 4: ("x", None), 5: ("b", '{"te\\nxt":"a"}')}
    files = [f"{tmp_dir}/in/{n}.csv" for n in "abc"]
    assert sorted(x.many_lines for x in csv_layouts(spark, files, '"')) == [False, True, True]
    write(f"{tmp_dir}/d", "d.csv", 'id,text\n6,"a \\" b"\n7,"c\nd \\"e\\""\n')  # a backslash before quotes, as Spark writes them
    rows = bronze_batch(spark, BronzeConfig(f"{tmp_dir}/d", "", "", expected={"id": "int", "text": "string"})).collect()
    assert {r.id: (r.text, r._rescued_data) for r in rows} == {6: ('a " b', None), 7: ('c\nd "e"', None)}


def test_names_go_as_spark_matches_them(spark, tmp_dir):
    write(f"{tmp_dir}/in", "a.csv", "\n \nID,a.b,_file,_corrupt,_same0,ID2,id2,,_c0\n1,2,f,c,s,8,9,e,z\n")
    rows = load(spark, tmp_dir, expected={"id": "int", "a.b": "int", "id2": "int"})
    assert [(r.id, r["a.b"], r.id2) for r in rows] == [(1, 2, 9)]
    assert json.loads(rows[0]._rescued_data) == {"_file": "f", "_corrupt": "c", "_same0": "s", "ID2": "8", "_c7": "e", "_c0": "z"}
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        cfg = BronzeConfig(f"{tmp_dir}/in", "", "", expected={"id": "int"})
        r = bronze_batch(spark, cfg).first()
        assert r.id is None and json.loads(r._rescued_data)["ID"] == "1"
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_parquet_structs_that_drift(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    for ddl, row in (("id long, s struct<a:int,b:string>, `x.y` int", (1, (1, "p"), 5)), ("id long, s struct<a:string,c:int>", (2, ("u", 3))),
                     ("id int, s array<int>, _file string", (3, [1, 2], "f")), ("ID long, s string", (4, '{"a":7}'))):
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(src)
    schema = StructType.fromDDL("id long, s struct<a:int,b:string>, `x.y` int")
    rows = {r.id: r for r in load(spark, tmp_dir, fmt="parquet", schema=schema)}
    assert {i: (r.s and tuple(r.s), r["x.y"], json.loads(r._rescued_data or "{}")) for i, r in rows.items()} == {
        1: ((1, "p"), 5, {}), 2: ((None, None), None, {"$.s.a": "u", "$.s.c": "3"}),
        3: (None, None, {"s": "[1,2]", "_file": "f"}), 4: ((7, None), None, {})}


def test_schema_inferred_from_nested_json(spark, tmp_dir):
    write(f"{tmp_dir}/in", "a.json", '{"id":1,"p":{"q":[1,2]}}\n')
    cfg = dict(fmt="json", schema_at=f"{tmp_dir}/schema")
    assert load(spark, tmp_dir, **cfg)[0].p.q == [1, 2]
    write(f"{tmp_dir}/in", "b.json", '{"id":2,"p":{"q":[3,"x"],"r":0}}\n')
    rows = {r.id: r for r in load(spark, tmp_dir, **cfg)}
    assert rows[2].p.q == [3, None] and json.loads(rows[2]._rescued_data) == {"$.p.q[1]": "x", "$.p.r": "0"}


def jobs(spark, f):
    """(what f returns, number of Spark jobs that it ran)"""
    sc = spark.sparkContext
    group = f"layouts-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_many_files_of_few_layouts(spark, tmp_dir):
    """Layouts that alternate from file to file: the jobs don't grow with the files."""
    for n, more in ((0, ["cast(id as string) AS u"]), (1, ["id AS u", "id AS w"]), (2, ["id AS u", "array(id) AS w"])):
        spark.range(0, 600, 1, 200).selectExpr("id AS k", *more).write.parquet(f"{tmp_dir}/in/{n}")
    files = sorted((os.path.join(d, f) for d, _, names in os.walk(f"{tmp_dir}/in") for f in names if f.endswith(".parquet")), key=os.path.basename)
    random.Random(1).shuffle(files)
    found, n = jobs(spark, lambda: parquet_layouts(spark, files))
    assert n < 20 and len(found) == 3
    assert sorted((len(v), {f.split("/")[-2] for f in v}.pop(), len({f.split("/")[-2] for f in v})) for v in found.values()) == [
        (200, "0", 1), (200, "1", 1), (200, "2", 1)]
    same = [f for f in files if "/in/1/" in f]
    assert jobs(spark, lambda: parquet_layouts(spark, same))[1] <= 2  # listing many paths may be a job, too


def test_files_without_rows_and_damaged_files(spark, tmp_dir):
    for n, ddl in enumerate(("k long", "k string", "k long", "k string", "k long", "k string")):
        spark.createDataFrame([], ddl).coalesce(1).write.parquet(f"{tmp_dir}/e{n}")
    files = [os.path.join(d, f) for n in range(6) for d, _, names in os.walk(f"{tmp_dir}/e{n}") for f in names if f.endswith(".parquet")]
    found = parquet_layouts(spark, files)
    assert sorted(map(len, found.values())) == [3, 3]
    write(f"{tmp_dir}/bad", "x.parquet", "not parquet")
    with pytest.raises(Exception):
        parquet_layouts(spark, [*files, f"{tmp_dir}/bad/x.parquet"])


def test_known_layouts_are_not_looked_up_again(spark, tmp_dir):
    for i in range(3):
        spark.createDataFrame([(i,)], "k long" if i else "k string" if i is None else "k int").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
    cfg = BronzeConfig(f"{tmp_dir}/in", "", "", fmt="parquet", schema=StructType.fromDDL("k long"), layouts_at=f"{tmp_dir}/layouts")
    first = sorted(r.k for r in bronze_batch(spark, cfg).collect())
    assert first == [0, 1, 2] and spark.read.parquet(cfg.layouts_at).count() == 3
    assert sorted(r.k for r in bronze_batch(spark, cfg).collect()) == first and spark.read.parquet(cfg.layouts_at).count() == 3
    spark.createDataFrame([("x",)], "k string").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
    rows = bronze_batch(spark, cfg).collect()
    assert sorted(str(r.k) for r in rows) == ["0", "1", "2", "None"] and spark.read.parquet(cfg.layouts_at).count() == 4
