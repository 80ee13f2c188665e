"""Context trees of several bytes against plain recursion, and what the query makes of them."""

import math
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import context_depths as D
from strata.llm import context_tree as T


def plain_tree(train, depth):
    """log10 probability of a text and its end by trees of this depth, node by node."""
    nodes, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        b = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(b)):
            u = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                for d in range(depth + 1):
                    nodes[b[i - d:i], u][bit] += 1
                    if d:
                        children[b[i - d + 1:i], u].add(b[i - d:i])
                u = 2 * u + bit

    def kt(n):
        return math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    weighted = {}
    for c, u in sorted(nodes, key=lambda x: -len(x[0])):
        a = kt(nodes[c, u])
        if len(c) < depth:
            below = sum(weighted[x, u] for x in children[c, u])
            m = max(a, below)
            a = m + math.log((math.exp(a - m) + math.exp(below - m)) / 2)
        weighted[c, u] = a

    def one(context, u):
        so_far, rest = 0.0, 1.0
        for d in range(depth + 1):
            c = context[len(context) - d:]
            n = nodes[c, u]
            q = (n[1] + .5) / (sum(n) + 1)
            if d == depth or (context[len(context) - d - 1:], u) not in nodes:
                return so_far + rest * q
            stop = math.exp(kt(n) - math.log(2) - weighted[c, u])
            so_far, rest = so_far + rest * stop * q, rest * (1 - stop)

    def score(t):
        b, out = b"\xff" * depth + t + b"\xff", 0.0
        for i in range(depth, len(b)):
            u = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                p = one(b[i - depth:i], u) if (b"", u) in nodes else .5
                out += math.log10(p if bit else 1 - p)
                u = 2 * u + bit
        return out
    return score


TEXTS = ["abracadabra", "The cat. The dog.", None, "", "aaaa bbbb aaaa", "é è abra", "abracadabra", "the dog sat on the cat",
         "cat dog zebra", "ÿþ\x00", "zzz " * 300, "abracadabrb"]


@pytest.mark.parametrize("depth,chunk", [(3, 1 << 25), (6, 1 << 25), (6, 40)])
def test_scores_equal_plain_trees_of_that_depth(spark, monkeypatch, depth, chunk):
    monkeypatch.setattr(D, "CHUNK", chunk)  # many chunks and buckets in the small run
    monkeypatch.setattr(D, "BUCKET", chunk)
    df = spark.createDataFrame([(i, t, i < 8, 1, "w") for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, known boolean, chunk int, bucket string").repartition(3)
    got = sorted(tuple(r) for r in T.score_deep(df, F.col("known"), depth=depth).collect())
    tree = plain_tree([T.lowered(t) for t in TEXTS[:8]], depth)
    base = sorted(tuple(r) for r in T.score(df, df.where("known")).collect())
    assert [r[0] for r in got] == list(range(len(TEXTS)))
    for r, b, t in zip(got, base, TEXTS):
        assert r[:4] == b[:4] and r[4] == pytest.approx(b[4], rel=1e-9)
        assert r[5] == pytest.approx(tree(T.lowered(t)), rel=1e-4)


def test_plain_tree_of_two_bytes_is_the_small_model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    tree = plain_tree([T.lowered(t) for t in TEXTS], 2)
    for r in T.score(df, df).collect():
        assert r.score == pytest.approx(tree(T.lowered(TEXTS[r.doc_id])), rel=1e-4)


def test_repeated_rows_null_ids_and_empty_training(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, "ab c"), (None, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in T.score_deep(df, F.lit(False)).collect()), key=str)
    assert rows[0][:4] == (1, 3, 0, 0) and rows[0] == rows[1] and rows[2][:4] == (None, 1, 0, 0)
    assert rows[0][4] == 0 and rows[0][5] == pytest.approx(5 * math.log10(1 / 256), rel=1e-5)
    assert T.score_deep(df.limit(0), F.lit(True)).count() == 0


def test_query_tells_order_that_two_bytes_do_not(spark, tmp_path):
    """Texts of equal trigrams: only longer contexts tell the one that training has."""
    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=7)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(400)]
    rows += [(1000 + i, " ".join("".join(rng.choices("ab", k=7)) for _ in range(40))) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in T.op7_context_tree(spark, str(tmp_path)).collect()}
    assert len(out) == 500
    small = {r.doc_id: r.score for r in T.score(*[spark.read.parquet(f"{tmp_path}/documents.parquet").where(c) for c in (
        "true", "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")]).collect()}
    known = [i for i in out if i < 1000 and out[i].held_out]
    assert known and np.mean([out[i].score for i in known]) > .9 * np.mean([small[i] for i in known])


def test_numbers_packed():
    x = np.array([0, 1, 255, 256, (1 << 56) - 1])
    assert (D.unpack_numbers(D.pack_numbers(x, 7), 5, 7) == x).all()
    assert len(D.unpack_numbers(D.pack_numbers(x[:0], 7), 0, 7)) == 0


def test_counts_and_lists_of_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab c", k=rng.randrange(200))) for _ in range(40)] + [b"a" * 500]
    trained = np.array([i % 3 > 0 for i in range(41)], np.int64)
    for piece in (1, 64, 1 << 16):
        monkeypatch.setattr(D, "PIECE", piece)
        want = defaultdict(int)
        for t, known in zip(texts, trained.tolist()):
            for g in D.grams([t], 6).tolist():
                want[g] += known
        keys, n = D.distinct(texts, trained, 6)
        assert dict(zip(keys.tolist(), n.tolist())) == want and (np.diff(keys) > 0).all()
        parts = dict(D.by_bucket(keys, 6, 5))
        assert sorted(i for x in parts.values() for a, z in x for i in range(a, z)) == list(range(len(keys)))
        lists = [D.distinct(texts[i::3], trained[i::3], 6) for i in range(3)]
        both = list(D.merged(lists, 6))
        assert np.array_equal(np.concatenate([k for k, _ in both]), keys)
        assert np.array_equal(np.concatenate([m for _, m in both]), n)


def peak_mb(f):
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_a_bucket_of_many_grams_takes_little_memory():
    """All grams differ, under 4,096 contexts of three bytes."""
    x = np.random.default_rng(1).integers(0, 1 << 44, 600_000)
    keys = np.unique((x >> 32 << 36) | x & (1 << 32) - 1)
    table = pa.table({"bucket": [0], "chunk": [7], "size": pa.array([len(keys)], pa.int32()), "grams": [D.pack_numbers(keys, 7)],
                      "n": [D.pack_numbers(np.ones(len(keys)), 4)]})
    D.log_kt(np.ones(1, int), np.ones(1, int))
    row, peak = peak_mb(lambda: D._bucket(6)(table).to_pylist()[0])
    assert row["size"] == len(keys) and sum(row["nodes"]) > 0 and peak < 130

    class Shared:
        value = D.Upper(D._upper(next(D._tops([pa.record_batch({"nodes": [row["nodes"]], "top": [row["top"]]})])).to_pandas()))
    answers, peak = peak_mb(lambda: list(D._answers(Shared, 6)([pa.RecordBatch.from_pylist([row])])))
    assert sum(map(len, answers)) == 1 and peak < 130


def test_a_chunk_is_sent_in_small_batches():
    text = np.random.default_rng(1).integers(97, 123, 4_000_000, np.uint8).tobytes()
    chunk = pa.RecordBatch.from_pylist([{"chunk": 1, "trained": [True], "sizes": [len(text)], "texts": D.packed(text)}])
    sizes, peak = peak_mb(lambda: [b.nbytes for b in D._lists(6, 50)([chunk])])
    assert max(sizes) < 4 * D.SLAB and peak < 180
