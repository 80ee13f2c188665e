"""Daily gold tables refreshed by touched days equal a full build."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from strata.sources.incremental import DailyTable, build, read_daily, refresh, touched

DDL = "id int, day date, cat string, amount int"
START = dt.date(2024, 1, 1)


def measures(rows):
    return rows.groupBy("day", "cat").agg(F.count_distinct("id").alias("orders"), F.sum("amount").alias("total"))


def total(rows):
    return rows.groupBy("day").agg(F.count_distinct("id").alias("orders"), F.sum("amount").alias("total"))


def gold(path, window, keyed=True):
    return DailyTable(path, measures if keyed else total, "orders", "avg", "day", ("cat",) if keyed else (), window, 3)


def plain(rows, window, keyed, n=3):
    """Brute force: {(day, cat): (orders, total, avg)}."""
    by = {}
    for i, day, cat, amount in rows:
        if day is not None:
            by.setdefault((day, cat if keyed else None), []).append((i, amount))
    orders = {k: len({i for i, _ in v}) for k, v in by.items()}
    out = {}
    for day, cat in by:
        days = sorted(d for d, c in by if c == cat and d <= day)
        days = days[-n:] if window == "rows" else [d for d in days if (day - d).days < n]
        out[day, cat] = (orders[day, cat], sum(a for _, a in by[day, cat]),
                         round(sum(orders[d, cat] for d in days) / len(days), 9))
    return out


def stored(g, spark):
    return {(r.day, r.cat if "cat" in r else None): (r.orders, r.total, round(r.avg, 9)) for r in read_daily(g, spark).collect()}


def day(r):
    return None if r.random() < .05 else START + dt.timedelta(days=r.randrange(130))


@pytest.mark.parametrize("window,keyed", [("rows", True), ("days", True), ("rows", False), ("days", False)])
def test_late_batches_equal_a_full_build(spark, tmp_dir, window, keyed):
    r = random.Random(f"{window}{keyed}")
    state = {i: (i, day(r), r.choice(["a", "b", None]), r.randrange(9)) for i in range(120)}
    frame = lambda rows: spark.createDataFrame(list(rows), DDL)
    g = gold(f"{tmp_dir}/gold", window, keyed)
    build(g, frame(state.values()))
    assert stored(g, spark) == plain(state.values(), window, keyed)
    for batch in range(3):
        ids = [*r.sample(range(120), 3), *range(200 + batch * 3, 203 + batch * 3)]
        old = [state.pop(i) for i in ids if i in state]  # rows move to other days, or go
        new = [(i, day(r), r.choice(["a", "b", None]), r.randrange(9)) for i in ids[1:]]
        state.update({x[0]: x for x in new})
        refresh(g, frame(state.values()), touched(g, frame(old), frame(new)))
        assert stored(g, spark) == plain(state.values(), window, keyed)
        if batch == 0:  # once more changes nothing
            refresh(g, frame(state.values()), touched(g, frame(old), frame(new)))
            assert stored(g, spark) == plain(state.values(), window, keyed)


def test_other_months_are_not_written_and_nothing_touched_writes_nothing(spark, tmp_dir):
    rows = [(i, START + dt.timedelta(days=i), "a", 1) for i in range(120)]
    g = gold(f"{tmp_dir}/gold", "rows", False)
    build(g, spark.createDataFrame(rows, DDL))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_dir}/gold/_month=*/*.parquet")}
    before = files()
    late = [(900, dt.date(2024, 2, 28), "a", 5), (901, None, "a", 5)]
    state = spark.createDataFrame(rows + late, DDL)
    refresh(g, state, touched(g, spark.createDataFrame(late[1:], DDL)))
    assert files() == before
    refresh(g, state, touched(g, spark.createDataFrame(late, DDL)))
    after = files()
    assert {f.split("_month=")[1][:7] for f in before if f not in after} == {"2024-02", "2024-03"}  # frames reach into March
    assert stored(g, spark) == plain(rows + late, "rows", False)


def test_a_month_that_lost_its_rows(spark, tmp_dir):
    rows = [(1, dt.date(2024, 1, 30), "a", 1), (2, dt.date(2024, 2, 10), "a", 1), (3, dt.date(2024, 3, 5), "a", 1)]
    g = gold(f"{tmp_dir}/gold", "rows")
    build(g, spark.createDataFrame(rows, DDL))
    left = [rows[0], rows[2]]
    refresh(g, spark.createDataFrame(left, DDL), touched(g, spark.createDataFrame(rows[1:2], DDL)))
    assert stored(g, spark) == plain(left, "rows", True)
