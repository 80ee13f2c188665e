"""The Jaccard join against all pairs on small tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from strata.llm import ngram_jaccard as J
from strata.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sets(text, k=3):
    w = WORDS.findall((text or "").translate(UP))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked_pairs(sets, percent):
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            yield a, b


def find_roots(sets, percent):
    """id -> least id that it reaches."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked_pairs(sets, percent):
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in sets}


def plain_join(docs, percent=90, words=3):
    sets = {i: plain_sets(t, words) for i, t in docs if i is not None}
    roots = find_roots(sets, percent)
    links = dict.fromkeys(sets, 0)
    for pair in linked_pairs(sets, percent):
        for i in pair:
            links[i] += 1
    return {i: (len(s), roots[i], links[i]) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


def test_whole_table(spark, docs_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{docs_dir}/documents.parquet").collect()]
    assert got(J.op8_ngram_jaccard(spark, docs_dir)) == plain_join(docs)


def near_copies(rng, n_groups=6, size=25):
    vocab = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(vocab, k=14))
    docs = []
    for _ in range(n_groups):
        base = rng.choices(vocab, k=rng.choice([5, 12, 40, 120]))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < .4:
                w = [line, *w]
            docs.append(" ".join(w))
    docs += [line + " " + rng.choice(vocab) for _ in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("spec", [J.JoinSpec(rare=2, frequent=3, block=7), J.JoinSpec(rare=4, frequent=9),
                                  J.JoinSpec(percent=70, words=2, rare=3, frequent=5, block=40), J.JoinSpec()])
def test_near_copies_with_hot_lines(spark, spec):
    docs = near_copies(random.Random(spec.frequent + spec.percent))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: len(plain_sets(t, spec.words)) for i, t in docs}
    want = {i: (sets[i], c, n) for i, (_, c, n) in plain_join(docs, spec.percent, spec.words).items()}
    assert got(J.jaccard_join(df, spec=spec)) == want


def test_intersections():
    rng = random.Random(1)
    sets = [sorted({rng.choice([rng.randrange(6), rng.randrange(400)]) for _ in range(rng.randrange(30))})
            for _ in range(150)]
    tok = np.array([t for x in sets for t in x])
    row = np.repeat(np.arange(150), [len(x) for x in sets])
    got = J.intersections(tok, row, 60, 90)
    assert got.tolist() == [[len(set(x) & set(y)) for y in sets[60:]] for x in sets[:60]]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c d"), (7, "a b c d"),
            (8, "a b c d"), (9, "x " * 30_000), (10, "x x x")]
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "doc_id long, text string, token string, size int")
    out = J.jaccard_join(df)
    assert out.count() == len(rows)
    assert got(out) == {1: (0, 1, 0), 2: (0, 2, 0), 3: (0, 3, 0), 4: (1, 4, 1), 5: (1, 4, 1), 6: (1, 6, 0),
                        7: (2, 7, 2), 8: (2, 7, 2), 9: (1, 9, 1), 10: (1, 9, 1)}
    left = J.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 7, 9]  # 7 stands there twice with one text
    null = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert got(J.jaccard_join(null)) == {None: (1, None, 0), 1: (1, 1, 0)}
    assert J.jaccard_join(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: r for n, r in root.items() if n != r}


@pytest.mark.parametrize("sent", [0.2, 2])
def test_large_clusters_in_passes(spark, monkeypatch, sent):
    """One cluster of sets of many sizes: sizes that can't be linked don't meet, and the passes are one table."""
    monkeypatch.setattr(J, "SENT", sent)
    spec = J.JoinSpec(rare=2, frequent=3, block=7)
    dealt = []
    monkeypatch.setattr(J, "_dealt", lambda *a, f=J._dealt: dealt.append(f(*a)) or dealt[-1])
    made = []
    monkeypatch.setattr(J, "materialize", lambda df, name="stage", *a, f=J.materialize: made.append(name) or f(df, name, *a))
    docs = near_copies(random.Random(7), n_groups=4)
    monkeypatch.setattr(J, "discard", lambda df: None)  # to look at the members afterwards
    assert got(J.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), spec=spec)) == plain_join(docs)
    (members, passes), = dealt
    assert made.count("found") == passes and (passes > 1) == (sent < 1)
    rows = members.collect()
    own = {r.rep: r for r in rows if r.own}
    assert max(r.others for r in rows) > 1 and len({r.block >> 32 for r in rows}) > 2
    # every set meets its own class and those beside it
    assert all(abs((r.other >> 32) - (own[r.rep].block >> 32)) <= 1 for r in rows)
    # what a pass sends, on average
    n = sum(r.n for r in own.values())
    assert sum(r.n * r.others for r in rows) <= passes * sent * n + n
