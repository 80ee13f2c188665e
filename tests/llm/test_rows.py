"""Row-wise operators against plain Python statements of their contracts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import quality_rules as Q
from strata.llm import secret_scan as S
from strata.llm import word_bpe as B

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "é" * 3, "a b c a b c", "x\n\nx\n x\n", "AKIA" + "A1" * 9, "token=abcdefgh",
       "a b c\x1c\x85d\xa0e a b c", "<|endoftext|> hi", "# * $ %", "line\nline\nline", "word " * 20000]


def plain_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines), len(lines) - len(set(lines)), len(hit))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t#é|\x85\x1c", max_size=60))
def test_measures(text):
    assert Q.measure(text)[:6] == plain_measures(text)


def test_quality_query_and_policies(spark, docs_dir):
    rows = Q.op9_quality_rules(spark, docs_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{docs_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, sym, _, dup, rep = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)


def test_quality_odd_rows_ablation_and_clashes(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)] + [(None, "dup", 2, "y")] * 2,
                               "doc_id long, text string, n_words int, ledger string")
    led = Q.apply_policy(Q.rule_ledger(df), Q.V2)
    assert led.count() == len(ODD) + 2
    n = {r.rule: r for r in Q.ablation(led, Q.BASE).collect()}
    kept = led.where(F.col("fail_bits").bitwiseAND(F.lit(Q.BASE.mask).cast("long")) == 0).count()
    failed = led.where("n_words < 50").count()
    assert n["few_words"].n_failed == failed
    assert n["few_words"].n_kept_without == kept + n["few_words"].n_only
    good = Q.keep_good(df, Q.BASE)
    assert good.columns == df.columns
    assert Q.rule_ledger(df.limit(0)).count() == 0


def test_toxic_documents_are_dropped(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(string(doc_id) as binary)) % 4 = 2")
    rows = Q.op9_toxic_words(spark, sf).join(docs, "doc_id").join(labels, "doc_id").collect()
    toxic, clean = ([r for r in rows if r.toxic == k and r.v2_kept] for k in (1, 0))
    assert len(toxic) > 80 and np.mean([not r.kept for r in toxic]) > .8
    assert np.mean([not r.kept for r in clean]) < .01
    for lang in ("en", "de", "fr"):
        assert np.mean([not r.kept for r in toxic if r.lang == lang]) > .7
    print({k: (sum(not r.kept for r in x), len(x)) for k, x in (("toxic", toxic), ("clean", clean))},
          {g: (sum(not r.kept for r in toxic if r.lang == g), sum(r.lang == g for r in toxic)) for g in ("en", "de", "fr", "es")})


def test_listed_words_odd_rows(spark):
    assert Q.n_listed(b"Bad, (bad) badly 'BAD!'", frozenset([b"bad"])) == 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "dup")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (0, None), (1, 1), (1, 0), (99, 1)], "doc_id long, toxic int")
    assert Q.toxic_words(df, labels) == Q.toxic_words(df.limit(0), labels.limit(0)) == frozenset()
    led = Q.rule_ledger(df)
    assert led.where(F.col("n_listed") > 0).count() == 0
    assert led.where(F.col("fail_bits").bitwiseAND(F.lit(Q.BIT["listed_words"]).cast("long")) != 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="AKI0af19 :=\"'_token", max_size=80))
def test_base_spans(text):
    want = [(m.start(), 0, m.end()) for m in S.ASSIGN.finditer(text) if len(m[2]) >= 8]
    want += [(m.start(), 1, m.end()) for m in S.ACCESS.finditer(text) if len(m[0]) >= 16]
    want += [(m.start(), 2, m.end()) for m in S.HEX.finditer(text) if len(m[0]) >= 32]
    assert S.base_spans(text) == sorted(want)


def test_chi2_cdf_matches_simulation():
    rng = np.random.default_rng(1)
    for df, shift in ((15.0, 0.0), (63.0, 40.0), (25.0, 10.0)):
        x = ((rng.normal(size=(40_000, int(df))) + np.sqrt(shift / df)) ** 2).sum(axis=1)
        for q in (.01, .2, .7):
            assert abs(S.chi2_cdf(np.array([np.quantile(x, q)]), np.array([df]), shift)[0] - q) < .01


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(7)
    key = lambda a, n: "".join(rng.choices(a, k=n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["internationalisation_of_the_state", "thisIsAQuiteLongCamelCaseNameInCode", "aaaaaaaaaaaaaaaaaaaaaaaa",
             "https-www-example-com-index-page-one", "2024010120240102202401032024", "responsibilitiesandmore"]
    rows = [(i, f"é some {words[i % len(words)]} text {i}", False) for i in range(300)]
    rows += [(1000 + i, f"here {key(b64, 64)} is", True) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, planted boolean")
    got = {r.doc_id: r.secrets for r in S.find_secrets(docs).collect()}
    assert not any(got[i] for i in range(300))
    found = [got[1000 + i] for i in range(40)]
    assert sum(map(bool, found)) >= 36
    assert all((x[0].start, x[0].end) == (5, 69) for x in found if x)
    masked = {r.doc_id: r.text for r in S.mask_secrets(docs).collect()}
    assert all(masked[1000 + i] == "here <SECRET> is" for i, x in enumerate(found) if x)
    assert masked[0] == rows[0][1]


@pytest.mark.parametrize(("alphabet", "length", "least"), [
    (64, 20, .3), (64, 24, .45), (64, 32, .8), (64, 40, .95), (64, 64, .99), (32, 64, .45), (36, 40, .65), (36, 64, .95)])
def test_few_keys_of_usual_length_among_many_runs(alphabet, length, least):
    rng = random.Random(length)
    of = {64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
          36: "abcdefghijklmnopqrstuvwxyz0123456789"}[alphabet]
    runs = [S.random_runs("".join(rng.choices(of, k=length)), [])[0][2:] for _ in range(400)]
    hist = np.zeros((S.N_STRATA, S.BINS))
    for stratum, at, _ in runs:
        hist[stratum, at] += 1
    hist[:, 0] += 9 * hist.sum(axis=1)  # nine ordinary runs for each key
    at_least = S.least_bins(hist, S.FDR)
    assert np.mean([ok and at >= at_least[stratum] for stratum, at, ok in runs]) >= least


def test_secret_query(spark, docs_dir):
    for r in S.op1_secret_scan(spark, docs_dir).collect():
        base = [x for x in r.spans.split(",") if x.split(":")[0] in S.KINDS]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert len(base) == r.n_assign + r.n_access + r.n_hex


def test_secret_odd_rows(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r.secrets for r in S.find_secrets(df).collect()}
    assert len(got) == len(ODD) and got[0] == []
    assert [(x.start, x.kind, x.end) for x in got[6]] == [(0, 1, 22)]
    assert [(x.start, x.kind, x.end) for x in got[7]] == [(0, 0, 14)]
    assert S.find_secrets(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(B.vocabulary_path())


def test_bpe_query_equals_library(spark, docs_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{docs_dir}/documents.parquet").collect()}
    rows = B.op3_word_bpe(spark, docs_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_odd_texts(library):
    encoder = B.load(open(B.vocabulary_path(), "rb").read())
    texts = [t or "" for t in ODD] + ["ΑΣ İ ﬁ é \x1c\x1d a　b", "don't '' 's'd", "a" * 700 + "xyz" * 300,
                                      "<|startoftext|><|endoftext|>x", "9" * 300]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder(t), "<u4").tolist() == ids
        assert B.decode_ids(encoder(t), encoder.vocabulary) == library.decode(ids, skip_special_tokens=False)


def test_bpe_scan_equals_heap():
    v = B.load(open(B.vocabulary_path(), "rb").read()).vocabulary
    rng = random.Random(3)
    for _ in range(400):
        parts = [v.inner[b] for b in "".join(rng.choices("abethonring", k=rng.randrange(2, 60))).encode()]
        assert v._scanned(list(parts)) == v._heaped(list(parts))


def test_bpe_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "keep"), (2, None, None)], "doc_id long, text string, source string")
    out = B.encode_decode(df, B.vocabulary_path()).withColumn("n", F.size(B.unpack(F.col("ids"))))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].source == "keep" and rows[1].n == 2
    assert rows[2].n == 0 and rows[2].decoded == ""
