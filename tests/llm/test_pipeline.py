"""Every stage of the pipeline, on what its predecessor kept, against a plain version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from strata.llm import quality_rules as Q
from strata.llm import secret_scan as S
from strata.llm import word_bpe as B
from tests.llm.test_decontaminate import plain
from tests.llm.test_jaccard import find_roots, plain_sets
from tests.llm.test_rows import plain_measures


def plain_listed(docs, labels):
    """Words of toxic documents, learned from labels that are not held out."""
    toxic = {}
    for i, t in labels:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            toxic[i] = max(t, toxic.get(i, t))
    n, bad = Counter(), Counter()
    for i, text in docs:
        if i in toxic:
            lower = "".join(c.lower() if c.isascii() else c for c in text or "")
            for w in {w.strip(".,;:!?\"'()") for w in re.split("[\t\n\x0b\x0c\r ]+", lower)}:
                if len(w) >= 4:
                    n[w] += 1
                    bad[w] += toxic[i] > 0
    return frozenset(w.encode() for w in n if bad[w] >= 4 and 10 * bad[w] >= 9 * n[w])


def test_listed_words_are_those_of_a_plain_count(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_listed([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()])
    assert Q.toxic_words(docs, labels) == want and len(want) > 0


def fails(text, listed=frozenset()):
    m = dict(zip(Q.MEASURES, Q.measure(text, listed)))
    assert tuple(m.values())[:6] == plain_measures(text)
    return (m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"] or 10 * m["n_symbols"] > 3 * m["n_words"]
            or 2 * m["n_dup_lines"] > m["n_lines"] or not 2 * m["n_words"] <= m["word_chars"] <= 40 * m["n_words"]
            or 2 * m["n_letters"] < m["word_chars"] or 10 * m["n_upper"] > 6 * m["n_letters"]
            or 2 * m["n_exclaim"] > m["n_words"] or 200 * m["n_listed"] > m["n_words"])


def test_stages_on_whole_table(spark, docs_dir):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{docs_dir}/benchmark.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{docs_dir}/labels.parquet").collect()]
    listed = plain_listed([(i, r["text"]) for i, r in rows.items()], labels)
    out = docs
    for name, stage in P.STAGES[:-1]:
        out = P.materialize(stage(spark, out, docs_dir), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = {r.doc_id: r.asDict() for r in out.collect()}
        if name == "quality_rules":
            rows = {i: r for i, r in rows.items() if not fails(r["text"], listed)}
        elif name == "ngram_jaccard":
            roots = find_roots({i: plain_sets(r["text"], 5) for i, r in rows.items()}, 80)
            rows = {i: r for i, r in rows.items() if roots[i] == i}
        elif name == "decontaminate":
            rows = {i: r for i, r in rows.items() if not plain(r["text"], items)[1]}
        else:
            for r in rows.values():
                spans = [dict(zip(("start", "kind", "end"), x)) for x in S.base_spans(r["text"] or "")]
                r["text"] = S.replace_spans(r["text"], spans, "<SECRET>")
                r["n_chars"] = len(r["text"])
        assert got == rows, name
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(B.vocabulary_path())
    want = {}
    for i, r in rows.items():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    last = P.STAGES[-1][1](spark, out, docs_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in last} == want
    assert {tuple(r) for r in P.run(spark, docs_dir).collect()} == {tuple(r) for r in last}


def test_stages_on_odd_rows(spark, docs_dir):
    made = lambda first, n: " ".join(first + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(n))
    long = made("w", 60)
    item = next(r.text for r in spark.read.parquet(f"{docs_dir}/benchmark.parquet").collect() if len(r.text.split()) >= 10)
    other = made("v", 70)
    rows = [(1, None, "en", "s", 0, "x"), (2, "", None, None, None, None), (3, long, "en", "s", 5, "y"),
            (3, long, "en", "s", 5, "y"), (None, long, "en", "s", 5, "z"), (4, long + " more", "en", "s", 9, "w"),
            (None, other, "en", "s", 5, "z"), (None, other, "en", "s", 5, "z"), (None, other + " more", "en", "s", 6, "z"),
            (7, made("u", 60), "en", "s", 7, "a"), (7, made("t", 60) + f" {item}", "en", "s", 8, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string")
    kept = []
    for docs in (df, df.limit(0)):
        for name, stage in P.STAGES[:-1]:
            docs = P.materialize(stage(spark, docs, docs_dir), name)
            assert docs.columns == df.columns
            kept.append(sorted((str(r.doc_id), r.text) for r in docs.collect()))
        P.STAGES[-1][1](spark, docs, docs_dir).count()
    pairs = lambda keep: sorted((str(rows[i][0]), rows[i][1]) for i in keep)
    assert kept[0] == pairs(range(2, 11))
    assert kept[1] in (pairs([2, 6, 9, 10]), pairs([2, 8, 9, 10]))  # of the group without ids either text stays
    assert kept[2] == kept[3] == [r for r in kept[1] if item not in r[1]]
    assert not any(kept[4:])


def test_one_row_of_each_group(spark):
    from strata.llm import ngram_jaccard as J
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "a"), (None, text, "b"), (3, text, "c"), (3, text, "c"), (4, text, "d"), (None, "", "e"), (None, "", "f"), (5, None, "g"), (5, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    got = sorted((r.doc_id or 0, r.text, r["rank"]) for r in J.one_of_each(df, spec=J.JoinSpec(words=5, percent=80)).fillna("", "text").collect())
    assert got == sorted([(0, "", "e"), (0, "", "f"), (3, text, "c"), (5, "", "g"), (5, "", "g")])
    only = df.where("doc_id is null and text <> ''")
    assert J.one_of_each(only).count() == 1
