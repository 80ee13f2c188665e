"""Decontamination against a plain scan."""

import hashlib
import random
import re

from strata.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(t):
    return WORDS.findall((t or "").translate(UP))


def plain(text, items, window=10):
    w = plain_words(text)
    hit, which = set(), set()
    for item, t in items:
        x = plain_words(t)
        k = min(window, len(x))
        wins = {tuple(x[i:i + k]) for i in range(len(x) - k + 1)} if k and item is not None else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                which.add(str(item))
    return len(w), len(hit), sorted(which)


def test_query_on_whole_tables(spark, docs_dir):
    read = lambda n: [tuple(r[:2]) for r in spark.read.parquet(f"{docs_dir}/{n}.parquet").collect()]
    items = read("benchmark")
    want = {i: plain(t, items) for i, t in read("documents")}
    rows = D.op10_decontaminate(spark, docs_dir).collect()
    assert len(rows) == len(want) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, which = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(which))
        assert r.items_sha256 == hashlib.sha256(",".join(which).encode()).hexdigest()
        assert r.contaminated == (hit > 0)


def test_odd_rows_short_items_and_overlaps(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "c", "É1", "über"]
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 7, 9, 10, 11, 14, 30])]
    items += [(7, "a b a"), (7, "a b a"), (50, None), (51, " .,"), (None, "a a")]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(40)))) for i in range(60)]
    docs += [(100 + i, "x, " + t + "-y") for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "a b " * 20_000), (203, items[10][1].upper()), (203, items[10][1].upper())]
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, shingle string, pos int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.contamination(d, b).collect())
    assert got == sorted((i, *plain(t, items)) for i, t in docs)
    long_items = b.where("item_id >= 8")
    left = D.drop_contaminated(d, long_items)
    clean = [i for i, t in docs if not plain(t, [x for x in items if x[0] is not None and x[0] >= 8])[1]]
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted(clean)


def test_empty_tables_and_null_ids(spark):
    d = spark.createDataFrame([(None, "q w e r t y u i o p"), (1, "q w e r t y u i o p"), (1, "other text")],
                              "doc_id long, text string")
    b = spark.createDataFrame([(5, "Q W E R T Y U I O P")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in D.contamination(d, b).collect())
    assert got == [("1", 2, 0, []), ("1", 10, 10, ["5"]), ("None", 10, 10, ["5"])]
    assert all(r.n_hit == 0 for r in D.contamination(d, b.limit(0)).collect())
    assert D.contamination(d.limit(0), b).count() == 0


def test_contaminated_rows_without_an_id_are_dropped(spark):
    d = spark.createDataFrame([(None, "q w e r t y u i o p", 1), (None, "Q W E R T Y U I O P!", 2), (None, "other text", 3),
                               (None, None, 4), (1, "q w e r t y u i o p", 5), (2, "other text", 6)],
                              "doc_id long, text string, key int")
    b = spark.createDataFrame([(5, "Q W E R T Y U I O P")], "item_id long, text string")
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns and sorted(r.key for r in left.collect()) == [3, 4, 6]


def test_plan_has_no_python(spark, docs_dir):
    plan = D.op10_decontaminate(spark, docs_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
