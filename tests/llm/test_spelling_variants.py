"""Spelling variants against plain edit distances, and the SQL on all words of a small table."""

import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import spelling_variants as V


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if distance_one(w, x)]
        form = min(near, key=lambda x: (-words[x], x), default=None)
        form = form if form and words[form] >= 2 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    rows = set()
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, *rest))
    return rows


def plain_words(docs, noise):
    words = Counter()
    for i, text in docs:
        for w in V.LETTERS.findall((text or "").translate(V.LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            words[w] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


@settings(max_examples=1000, deadline=None)
@given(st.text("aabcé0", min_size=1, max_size=14), st.data())
def test_near_words_share_a_signature_in_the_two_roles(word, data):
    i, c = data.draw(st.integers(0, len(word))), data.draw(st.sampled_from("abcdé0"))
    for other in (word[:i] + c + word[i:], word[:i] + c + word[i + 1:]):
        if not distance_one(word, other):
            continue
        met = lambda x, y: set(V.signatures(x, True)) & set(V.signatures(y, False))
        assert met(word, other) or met(other, word)


def test_groups_against_every_pair(spark):
    r = random.Random(5)
    words = {}
    while len(words) < 700:
        w = "".join(r.choice(["th", "er", "an", "in", "é"]) for _ in range(r.randint(2, 4)))
        for _ in range(r.randint(1, 4)):
            words[w] = r.choice([3, 4, 6, 7, 14, 100, 1000])
            i = r.randrange(len(w))
            w = r.choice([w[:i] + r.choice("aehtx") + w[i + r.randint(0, 1):], w[:i] + w[i + 1:]]) or "a"
    rows = V.group_variants(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect()
    assert len(rows) == len(words) and set(map(tuple, rows)) == plain_groups(words)
    assert max(r.n_near for r in rows) > 5 and any(r.root not in (r.word, r.form) for r in rows)


def test_one_large_family_of_words(spark):
    """All words over two letters: each has all its neighbours, whatever their number."""
    words = {"".join("ab"[k >> i & 1] for i in range(9)): 3 + k for k in range(512)}
    pairs = V.near_pairs(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect()
    assert len(pairs) == len({(p.word, p.other) for p in pairs}) == 512 * 9 // 2


def test_long_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(21)]
    rows = V.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert sorted(map(tuple, rows)) == sorted((w, "w21") for w, _ in forms)


def test_counts_and_odd_rows(spark):
    data = [(1, None), (2, ""), (3, "Color COLOUR colour, colour; café-color"), (3, "Color color colour"), (None, "color\xd7colour"),
            (0, "ÉTÉS étés étésé " * 3), (5, "x" * 100_000 + " " + "y" * 100_000)] + [(i, "thing thinking thong thing") for i in range(10, 300)]
    df = spark.createDataFrame([(*d, 7, "s") for d in data], "doc_id long, text string, n int, word string")
    for noise in (0, 97, 2):
        got = {r.word: r.n for r in V.count_words(df, noise=noise).collect()}
        assert got == plain_words(data, noise)
    rows = V.group_variants(V.count_words(df, noise=2)).collect()
    assert set(map(tuple, rows)) == plain_groups(plain_words(data, 2))
    assert V.group_variants(V.count_words(df.limit(0))).collect() == []
    assert V.count_words(df, least_count=1).where("length(word) > 1000").count() == 2


def test_nothing_is_broadcast_by_the_size_of_files(spark, tmp_dir):
    """The signatures are many times the words' file, which Spark would broadcast them by."""
    spark.createDataFrame([(f"word{i}", 3 + i) for i in range(50)], "word string, n long").write.parquet(tmp_dir + "/words")
    words = spark.read.parquet(tmp_dir + "/words")
    for df in (V.near_pairs(words), V.group_variants(words)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
