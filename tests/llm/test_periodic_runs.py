"""Periodic runs against a plain search of every start and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import periodic_runs as P


def plain_runs(w):
    """Every maximal stretch of every period, smallest period first."""
    found = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and w[k] == w[k + q]:
                k += 1
            if k - i + q >= max(6, 4 * q):
                found.setdefault((i, k - i + q), q)
            i = max(k, i) + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, text):
    w = plain_planted(doc_id, text)
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(((-m, s, q) for s, m, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def numbers(texts):
    ids = {}
    return [np.array([ids.setdefault(x, len(ids) + 1) for x in t], np.int64) for t in texts]


def test_the_cover_synchronises_any_two_places():
    assert {(a - b) % P.COVER_MOD for a in P.COVER for b in P.COVER} == set(range(P.COVER_MOD))
    a, b = np.meshgrid(np.arange(P.COVER_MOD), np.arange(P.COVER_MOD))
    for x in (a, b):
        assert np.isin((x + P.SHIFT[a, b]) % P.COVER_MOD, P.COVER).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=70), max_size=4))
def test_runs_of_few_letters(texts):
    assert P.runs_of(numbers(texts)) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_runs_beyond_the_cover(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(6):
        t = []
        while len(t) < r.choice([50, 400, 1500]):
            part = [r.choice("abcde"[:r.randint(1, 5)]) for _ in range(r.choice([1, 2, 3, 7, 31, 62, 90]))]
            t += part * r.randint(1, 9) + part[:r.randint(0, len(part))]
        texts.append(t)
    assert P.runs_of(numbers(texts)) == [plain_runs(t) for t in texts]


def test_extensions_match_a_plain_comparison():
    r = np.random.default_rng(3)
    w = np.concatenate([np.tile(r.integers(1, 3, 45), 20), r.integers(1, 3, 300), [9]])
    e = P.Extensions(w)
    i = r.integers(0, len(w) - 1, 4000)
    j = r.integers(0, len(w) - 1, 4000)
    i, j = i[i != j], j[i != j]
    assert (e(i, j) == P.matching(w, i, j, len(w))).all()


def test_query_against_plain_rows(spark, docs_dir):
    rows = sorted(map(tuple, P.op13_periodic_runs(spark, docs_dir).collect()))
    texts = spark.read.parquet(f"{docs_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows == sorted(plain_row(*t) for t in texts)
    assert sum(r[1] > 0 for r in rows) > 5


def test_odd_rows(spark):
    long = "word " * 20000 + " ".join(str(k % 977) for k in range(9000))
    data = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a b c " * 4), (4, "a b c " * 4), (None, "x " * 6), (5, "x " * 5),
            (6, "é\xa0é " * 7), (7, long), (None, None)]
    df = spark.createDataFrame([(*d, 1, "s") for d in data], "doc_id long, text string, n_words int, runs string")
    rows = P.periodic_runs(df).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in rows), key=key)
    assert got == sorted(((i, [(0, 20000, 1), (20000, 9000, 977)] if t is long else plain_runs((t or "").encode().split()))
                          for i, t in data), key=key)
    text = {r.doc_id: r.collapsed for r in rows}
    assert text[4] == "a b c" and text[1] == text[2] == text[3] == "" and text[5] == "x x x x x"
    assert text[7] == " ".join(["word", *map(str, range(977))])
    assert P.periodic_runs(df.limit(0)).collect() == []
    assert P.planted(df).columns == ["doc_id", "text"]
    words = {(r.doc_id, tuple(r.text.encode().split())) for r in P.planted(df).where("text is not null").collect()}
    assert words == {(i, tuple(plain_planted(i, t))) for i, t in data if t is not None}
