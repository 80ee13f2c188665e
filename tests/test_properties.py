"""Property tests: Spark operators against plain-Python brute force on
generated inputs (one Spark job per generated batch)."""

import datetime as dt
from decimal import Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions.items import parse_items
from strata.operators.dedupe import keep_latest

FIELD = st.one_of(st.integers(-5, 500).map(str), st.sampled_from(["", " 7 ", "x", "1.5", "19.99", "bad"]))
ITEM = st.lists(FIELD, min_size=0, max_size=4).map(":".join)
LIST = st.one_of(st.lists(ITEM, min_size=1, max_size=4).map(lambda xs: "[" + "|".join(xs) + "]"),
                 st.sampled_from(["NULL", "", "[]", "garbage", " [1:2:3] "]))


def _int(s):
    s = s.strip()
    try:
        return int(s) if s and (s.lstrip("-").isdigit()) else None
    except ValueError:
        return None


def _dec(s):
    s = s.strip()
    try:
        d = Decimal(s)
    except InvalidOperation:
        return None
    if not d.is_finite():
        return None
    return d.quantize(Decimal("0.01"))


def brute_parse(text):
    if text is None:
        return None
    t = text.strip(" ")
    if not (t.startswith("[") and t.endswith("]")) or t[1:-1].strip(" ") == "":
        return None
    out = []
    for item in t[1:-1].split("|"):
        f = item.split(":")
        get = lambda i: f[i] if i < len(f) else None
        out.append((None if get(0) is None else _int(get(0)),
                    None if get(1) is None else _int(get(1)),
                    None if get(2) is None else _dec(get(2))))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(LIST, min_size=1, max_size=40))
def test_parse_items_matches_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (None if r.p is None else [tuple(x) for x in r.p])
           for r in df.select("i", parse_items("t").alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_parse(t), t


ROWS = st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 3)),
                          st.integers(0, 9)), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None)
@given(ROWS)
def test_keep_latest_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k int, ts int, v int")
    got = sorted(map(tuple, keep_latest(df, ["k"], ["ts"]).collect()))
    best = {}
    for k, ts, v in rows:
        # ts DESC NULLS LAST, then payload (hash, then values) -- compare on
        # (ts is not None, ts) and accept any row with the top ts
        key = (ts is not None, ts if ts is not None else -1)
        if k not in best or key > best[k][0]:
            best[k] = (key, {(k, ts, v)})
        elif key == best[k][0]:
            best[k][1].add((k, ts, v))
    assert len(got) == len(best)
    for r in got:
        assert r in best[r[0]][1]


DATES = st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2030, 12, 31)).map(
    lambda d: d.replace(microsecond=0))
RENDER = [("%Y/%m/%d %H:%M:%S", True), ("%d-%b-%Y", False), ("%Y-%m-%d %H:%M:%S", True),
          ("%Y-%m-%d", False), ("%Y/%m/%d", False), ("%d/%m/%Y %H:%M:%S", True)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(DATES, st.integers(0, len(RENDER))), min_size=1, max_size=30))
def test_parse_ts_roundtrip(spark, items):
    from strata.functions.dates import parse_ts
    texts, want = [], []
    for d, i in items:
        if i == len(RENDER):
            texts.append("not a date")
            want.append(None)
            continue
        fmt, has_time = RENDER[i]
        texts.append(d.strftime(fmt))
        want.append(d if has_time else d.replace(hour=0, minute=0, second=0))
    df = spark.createDataFrame([(j, t) for j, t in enumerate(texts)], "j int, t string")
    got = {r.j: r.p for r in df.select("j", parse_ts("t", ntz=True).alias("p")).collect()}
    assert [got[j] for j in range(len(texts))] == want


CELL = st.one_of(st.none(), st.integers(-10**6, 10**6).map(str), st.sampled_from(
    ["FREE", "1.5", " 42 ", "", "2026/08/01", "1e3", "NaN", "-0", "12345678901234567890", "a\"b", "x,y"]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(CELL, CELL), min_size=1, max_size=30))
def test_rescue_never_loses_a_value(spark, rows):
    """Every non-NULL input value is either typed or present verbatim in
    ``_rescued_data`` (SRC7)."""
    import json

    from strata.sources.rescue import rescue_columns
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    out = {r.i: r for r in rescue_columns(df, {"a": "int", "b": "decimal(18,2)"}).collect()}
    for i, (a, b) in enumerate(rows):
        r = out[i]
        rescued = json.loads(r._rescued_data) if r._rescued_data else {}
        for name, raw in (("a", a), ("b", b)):
            typed = getattr(r, name)
            if raw is None:
                assert typed is None and name not in rescued
            else:
                assert (typed is not None) != (name in rescued), (name, raw, typed, rescued)
                if name in rescued:
                    assert rescued[name] == raw


def _brute_block(text, language):
    """Plain-Python statement of TX1: first fenced block tagged `language`
    (tag case-insensitive, anything may follow the tag on its line), else
    the first fenced block of any tag, else the text; stripped."""
    import re
    tagged = re.search(r"`{3,}" + re.escape(language) + r"\b[^\n]*\n(.*?)\n`{3,}", text,
                       re.DOTALL | re.IGNORECASE)
    if tagged:
        return tagged.group(1).strip()
    anyb = re.search(r"`{3,}[^\n]*\n(.*?)\n`{3,}", text, re.DOTALL)
    if anyb:
        return anyb.group(1).strip()
    return text.strip()


WORD = st.sampled_from(["select 1", "a: 1", "from t", "x", "", "  ", "\t", "é", "k: v"])
TAG = st.sampled_from(["sql", "SQL", "Sql filename=m.sql", "yaml", "yml", "python", "", "sqlx", "sql "])
BLOCK = st.builds(lambda n, tag, body, m: "`" * n + tag + "\n" + body + "\n" + "`" * m,
                  st.integers(3, 5), TAG, st.lists(WORD, max_size=3).map("\n".join), st.integers(3, 5))
TEXT = st.lists(st.one_of(BLOCK, WORD, st.just("\n")), min_size=0, max_size=5).map("\n".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=25))
def test_extract_block_matches_brute_force(spark, texts):
    from strata.functions.text import extract_block
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", extract_block("t", "sql").alias("s"), extract_block("t", "yaml").alias("y")).collect()
    got = {r.i: (r.s, r.y) for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == (_brute_block(t, "sql"), _brute_block(t, "yaml")), repr(t)
