"""Language identification and context-tree scoring: held-out quality and exact parts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strata.llm import context_tree as T
from strata.llm import language_id as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_language_id_on_held_out_documents(spark, documents):
    rows = L.op2_language_id(spark, SF).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    right = [r.lang_pred == documents[r.doc_id].lang for r in test]
    assert len(test) > 150 and np.mean(right) > .97
    assert all(0 <= r.score <= 1 for r in rows)
    assert abs(np.mean([r.score for r in test]) - np.mean(right)) < .06  # calibrated


def test_language_id_odd_rows(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "de"), ("123 !!", "en"), ("", None),
         ("the end", None), ("und " * 30_000, "de"), ("the cat and the dog", "en")] * 8)] + [(None, "the the", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = L.train(df)
    assert model.languages == ("de", "en")
    got = {r.text: r.lang_id for r in L.identify(df, model).collect()}
    assert got[None].lang == got["123 !!"].lang == got[""].lang == "und" and got[""].score == 0
    assert got["the end"].lang == "en" and got["der hund und die katze"].lang == "de"
    none = L.train(df.limit(0))
    assert {r.lang_id.lang for r in L.identify(df, none).collect()} == {"und"}
    one = L.train(df.where("lang = 'en'"))
    assert L.identify(df.where("doc_id = 1"), one).first().lang_id == ("en", 1.0)


def test_ftrl_penalties_make_weights_sparse_and_small():
    rng = np.random.default_rng(0)
    rows = [(int(y), np.arange(20), rng.normal(size=20) + 3 * (np.arange(20) == y)) for y in rng.integers(0, 3, 400)]
    fit = {}
    for name, spec in {"none": L.Spec(l1=0, l2=0), "l1": L.Spec(l1=8.0, l2=0), "l2": L.Spec(l1=0, l2=50.0)}.items():
        z, n = np.zeros((21, 3)), np.zeros((21, 3))
        L.ftrl_pass(iter(rows), z, n, spec)
        fit[name] = L.ftrl_weights(z, n, spec)
    assert (fit["l1"] == 0).mean() > .4 > .1 > (fit["none"] == 0).mean()
    assert np.abs(fit["l2"]).sum() < np.abs(fit["none"]).sum()
    right = [(np.r_[x, 1] @ fit["none"]).argmax() == y for y, _, x in rows]
    assert np.mean(right) > .9


def test_grams_fold_case_and_signs():
    assert Counter(L.grams("Ab, c!", 1 << 15)) == Counter(L.grams("  ab--C ", 1 << 15))
    assert len(L.grams("12 .", 99)) == len(L.grams(None, 99)) == 0


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(texts, train):
    words = lambda t: [*WORDS.findall((t or "").translate(UP)), None]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(len(words(t)), sum(c[w] > 0 for w in words(t)), n,
             sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for t in texts]


def plain_tree(train):
    """Context-tree weighting, one dictionary node at a time: (context, place) -> counts."""
    nodes = {}
    for t in train:
        b = b"\xff\xff" + t + b"\xff"
        for i in range(2, len(b)):
            u = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                for d in range(3):
                    nodes.setdefault((b[i - d:i], u), [0, 0])[bit] += 1
                u = 2 * u + bit

    def kt(n):
        return math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    weighted = {}
    for d in (2, 1, 0):
        for (c, u), n in nodes.items():
            if len(c) == d:
                below = sum(weighted.get((bytes([x]) + c, u), 0.0) for x in range(256)) if d < 2 else kt(n)
                a = kt(n)
                m = max(a, below)
                weighted[c, u] = m + math.log((math.exp(a - m) + math.exp(below - m)) / 2)

    def one(c, u, d=0):
        n = nodes[c[len(c) - d:], u]
        p = (n[1] + .5) / (sum(n) + 1)
        if d == 2 or (c[len(c) - d - 1:], u) not in nodes:
            return p
        stop = math.exp(kt(n) - math.log(2) - weighted[c[len(c) - d:], u])
        return stop * p + (1 - stop) * one(c, u, d + 1)

    def score(t):
        b, out = b"\xff\xff" + t + b"\xff", 0.0
        for i in range(2, len(b)):
            u = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                p = one(b[i - 2:i], u) if (b"", u) in nodes else .5
                out += math.log10(p if bit else 1 - p)
                u = 2 * u + bit
        return out
    return score


def test_log_gamma():
    x = np.array([.5, 1, 1.5, 7.5, 1e3 + .5, 1e9])
    assert np.allclose(T.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_scores_equal_a_plain_tree_and_plain_counts(spark):
    train = ["abracadabra", "The cat. The dog.", None, "", "aaaa bbbb aaaa", "é è abra", "abracadabra"]
    texts = [*train, "cat dog zebra", "ÿþ\x00", "zzz " * 3000]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, n int, word string")
    got = sorted(tuple(r) for r in T.score(df, df.where(f"doc_id < {len(train)}")).collect())
    tree = plain_tree([T.lowered(t) for t in train])
    for (i, *base, score), want, t in zip(got, plain_base(texts, train), texts):
        assert base[:3] == list(want[:3]) and base[3] == pytest.approx(want[3], rel=1e-9)
        assert score == pytest.approx(tree(T.lowered(t)), rel=1e-4)


def test_tree_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("the cat sat on the mat",), ("a cat",)], "text string")
    model = T.tree_model(T.statistics(df))
    assert np.allclose((10.0 ** model.logs.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, "ab c"), (None, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in T.score(df, df.limit(0)).collect()), key=str)
    assert rows[0][:4] == (1, 3, 0, 0) and rows[0] == rows[1]
    assert rows[0][4] == 0 and rows[0][5] == pytest.approx(5 * math.log10(1 / 256), rel=1e-5)
    assert rows[2][:4] == (None, 1, 0, 0)
    assert T.score(df.limit(0), df).count() == 0


def test_context_tree_query(spark, documents):
    rows = {r.doc_id: r for r in T.op7_context_tree(spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    assert {i: r.held_out for i, r in rows.items()} == held
    ids = sorted(documents)
    base = plain_base([documents[i].text for i in ids], [documents[i].text for i in ids if not held[i]])
    for i, want in zip(ids, base):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
    test = [i for i in ids if held[i]]
    bits = -sum(rows[i].score for i in test) / math.log10(2) / sum(len(documents[i].text.encode()) + 1 for i in test)
    assert 1.5 < bits < 3.6  # far under the 8 of no model and the 4 or so of single bytes
