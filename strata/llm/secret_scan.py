r"""Secrets in text: fixed patterns plus a battery of randomness tests.

The patterns (``assign``, ``access``, ``hex``) are certain finds.  The battery
looks at every maximal run of 16 or more token characters:

1. *Encoding*: the smallest known alphabet that holds all its characters.
2. *Is it text?*  Pearson's statistic against a uniform alphabet is far larger
   for text than for random characters.  Its distribution under text is a
   non-central chi-squared, whose non-centrality grows with the length, so the
   p-value -- how often text of this length looks so even -- is length-aware.
3. *Is it random?*  The same statistic, a runs test about the middle of the
   alphabet and the lag-1 serial correlation must not reject randomness.
4. *False discoveries*: the p-values of 2 go through Benjamini-Hochberg within
   each stratum (encoding x length class) over the whole corpus.  A stratum's
   threshold comes from a histogram of log p of fixed size, never from the
   list of runs, and p-values are rounded up to their bin.

Defined results: null text is empty and has no spans; an empty table gives an
empty result; repeated rows are each scanned (and each count as tests); texts
are scanned whole; offsets are code points, ends exclusive; a run inside a
certain find is not tested.  Input columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import col, fresh, read_table, slices, workers_import
from strata.session import materialize

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: One of these is in the lower-cased text wherever ASSIGN matches.
_HINTS = ("passw", "secret", "token", "api")

# Relative frequency of letters a to z in English text.
LETTER_FREQUENCY = (
    .0817, .0149, .0278, .0425, .1270, .0223, .0202, .0609, .0697, .0015, .0077, .0403, .0241,
    .0675, .0751, .0193, .0010, .0599, .0633, .0906, .0276, .0098, .0236, .0015, .0197, .0007)

#: Shares of upper case, lower case, digits and signs in the names and words of a text.
CLASS_SHARE = (.10, .80, .08, .02)

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b)) for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A)))
#: Smallest first, so that the first that fits is the one inferred.
ENCODINGS = {
    "digits": _DIGIT,
    "hex": _DIGIT + _LOWER[:6],
    "hex_upper": _DIGIT + _UPPER[:6],
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + b"234567",
    "lower_digits": _DIGIT + _LOWER,
    "upper_digits": _DIGIT + _UPPER,
    "letters": _UPPER + _LOWER,
    "alphanumeric": _DIGIT + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGIT + b"+/",
    "base64_url": _UPPER + _LOWER + _DIGIT + b"-_",
    "token": _UPPER + _LOWER + _DIGIT + b"+/-_",
}
#: Lower ends of the length classes.
LENGTHS = (16, 24, 32, 48, 64, 128)
N_STRATA = len(ENCODINGS) * len(LENGTHS)
#: Histogram of p-values: bin b holds 10 ** -((b + 1) / 8) < p <= 10 ** -(b / 8).
BINS, PER_DECADE = 400, 8
#: A run whose even spread, runs or serial correlation is rarer than this among random strings isn't random.
ALPHA = 0.001
#: The share of false finds that is accepted in a stratum.
FDR = 0.05

_TEXT_P = np.zeros(256)
for _set in (_UPPER, _LOWER):
    _TEXT_P[list(_set)] = LETTER_FREQUENCY
# digits in text: small ones lead, as in Benford's law
_TEXT_P[list(_DIGIT)] = np.log10(1 + 1 / (np.arange(10) + 1)) / np.log10(1 + 1 / (np.arange(10) + 1)).sum()
_TEXT_P[list(b"+/-_")] = .25
_CLASS = np.full(256, 3)
for _i, _set in enumerate((_UPPER, _LOWER, _DIGIT)):
    _CLASS[list(_set)] = _i
_SYMBOL = np.full((len(ENCODINGS), 256), -1)
for _i, _set in enumerate(ENCODINGS.values()):
    _SYMBOL[_i, list(_set)] = np.arange(len(_set))
_SIZE = np.array([len(a) for a in ENCODINGS.values()])


def _uneven(alphabet: bytes) -> float:
    """Non-centrality per character of Pearson's statistic, for text in this alphabet."""
    letters = np.frombuffer(alphabet, np.uint8)
    p = _TEXT_P[letters] * np.array(CLASS_SHARE)[_CLASS[letters]]
    return len(letters) * float(np.square(p / p.sum()).sum()) - 1


_UNEVEN = np.array([_uneven(a) for a in ENCODINGS.values()])


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """Phi(z), by the series of the scaled complementary error function (relative error under 2e-7)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + x / 2)
    # Coefficients of the Chebyshev fit to erfc(x) exp(x^2) / t.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    tail = t * np.exp(-x * x + np.polynomial.polynomial.polyval(t, c)) / 2
    return np.where(z < 0, tail, 1 - tail)


def chi2_cdf(x: np.ndarray, df: np.ndarray, shift: np.ndarray | float = 0.0) -> np.ndarray:
    """P(X <= x) for a chi-squared with ``df`` degrees and non-centrality ``shift``:
    Patnaik's central match, then the cube-root normal form of Wilson and Hilferty."""
    scale = (df + 2 * shift) / (df + shift)
    h = (df + shift) ** 2 / (df + 2 * shift)
    v = 2 / (9 * h)
    return _normal_cdf((np.cbrt(np.maximum(x, 0) / (scale * h)) - (1 - v)) / np.sqrt(v))


def infer_encoding(run: bytes) -> int:
    """Place in ENCODINGS of the smallest alphabet with every character of ``run``."""
    for i, alphabet in enumerate(ENCODINGS.values()):
        if not run.translate(None, alphabet):
            return i
    raise ValueError("not a run of token characters")


def battery(run: bytes) -> tuple[int, float, float]:
    """(encoding, p-value as text, least p-value as a random string) of a run."""
    e = infer_encoding(run)
    k, n = int(_SIZE[e]), len(run)
    raw = np.frombuffer(run, np.uint8)
    sym = _SYMBOL[e, raw]
    stat = float(np.square(np.bincount(sym, minlength=k)).sum()) * k / n - n
    shift = n * _UNEVEN[e]
    df = np.array([k - 1.0])
    as_text = float(chi2_cdf(np.array([stat]), df, shift)[0])
    uniform = 2 * min(u := float(chi2_cdf(np.array([stat]), df)[0]), 1 - u)
    high = sym >= k // 2
    n1 = int(high.sum())
    n0 = n - n1
    if not n0 or not n1:
        return e, as_text, 0.0
    mean = 2 * n0 * n1 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    z_runs = (runs - mean) / np.sqrt(var) if var > 0 else 0.0
    dev = sym - sym.mean()
    z_serial = float((dev[1:] * dev[:-1]).sum() / np.square(dev).sum() * np.sqrt(n)) + 1 / np.sqrt(n)
    tails = 2 * _normal_cdf(-np.abs(np.array([z_runs, z_serial])))
    return e, as_text, float(min(uniform, *tails))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    if any(h in (low := text.lower()) for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a maximal run of 32 or more is exactly a leftmost match of HEX that is long enough
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def random_runs(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, stratum, bin, random) of the runs outside known finds; all are
    tests of the false-discovery control, those with ``random`` can be finds."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if any(s <= a and b <= e for s, _, e in known):
            continue
        e, as_text, as_random = battery(m[0].encode())
        length = int(np.searchsorted(LENGTHS, b - a, "right")) - 1
        at = int(min(BINS - 1, np.floor(-np.log10(max(as_text, 1e-300)) * PER_DECADE)))
        out.append((a, b, e * len(LENGTHS) + length, max(at, 0), as_random >= ALPHA))
    return out


_SPAN = "struct<start:int,kind:int,end:int>"
_TEST = "struct<start:int,end:int,stratum:int,bin:int,random:boolean>"


def _scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    test = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()),
                               ("bin", pa.int32()), ("random", pa.bool_())]))
    for batch in slices(texts):
        found = [(known := base_spans(t), random_runs(t, known)) for t in (x.as_py() or "" for x in batch)]
        yield pa.StructArray.from_arrays([
            pa.array([[dict(zip(("start", "kind", "end"), s)) for s in known] for known, _ in found], span),
            pa.array([[dict(zip(("start", "end", "stratum", "bin", "random"), s)) for s in tests]
                      for _, tests in found], test)], ["base", "tests"])


def scan(text: Column) -> Column:
    """struct<base, tests>: certain finds and tested runs of one text."""
    return F.arrow_udf(_scan, f"base array<{_SPAN}>, tests array<{_TEST}>")(text)


def thresholds(scanned: DataFrame, tests: str, fdr: float = FDR) -> list[int]:
    """Per stratum, the least bin whose p-values are discoveries (BINS: none).

    Benjamini-Hochberg on the histogram: at most strata x bins rows reach the
    driver, whatever the corpus."""
    t = scanned.select(F.explode(col(tests)).alias("t")).select("t.stratum", "t.bin")
    hist = np.zeros((N_STRATA, BINS))
    for stratum, at, n in t.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect():
        hist[stratum, at] = n
    return least_bins(hist, fdr)


def least_bins(hist: np.ndarray, fdr: float) -> list[int]:
    """The same, from the strata x bins counts of tests."""
    upto = hist[:, ::-1].cumsum(axis=1)[:, ::-1]  # tests in this bin or beyond
    p = 10.0 ** -(np.arange(BINS) / PER_DECADE)
    passed = (p * hist.sum(axis=1, keepdims=True) <= fdr * upto) & (upto > 0)
    return [int(np.argmax(row)) if row.any() else BINS for row in passed]


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", fdr: float = FDR) -> DataFrame:
    """``docs`` with a column ``out``: array<struct<start, kind, end>> of all finds in
    order; kinds are those of KINDS, then the encodings of random runs.

    The texts are scanned twice, for the corpus-wide thresholds and for the
    result, so that nothing of their size is stored or shuffled."""
    workers_import(docs.sparkSession)
    s = fresh(docs, "scan")
    at_least = thresholds(docs.select(scan(col(text_col))["tests"].alias("tests")), "tests", fdr)
    return _decided(docs.withColumn(s, scan(col(text_col))), s, out, at_least)


def _decided(scanned: DataFrame, s: str, out: str, at_least: list[int]) -> DataFrame:
    at_least = F.array(*[F.lit(b) for b in at_least])
    added = F.transform(
        F.filter(col(s)["tests"], lambda t: t["random"] & (t["bin"] >= at_least[t["stratum"]])),
        lambda t: F.struct(t["start"].alias("start"),
                           (len(KINDS) + F.floor(t["stratum"] / len(LENGTHS))).cast("int").alias("kind"),
                           t["end"].alias("end")))
    return scanned.withColumn(out, F.array_sort(F.concat(col(s)["base"], added))).drop(s)


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in chain(KINDS, (f"random_{e}" for e in ENCODINGS))])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "<SECRET>", fdr: float = FDR) -> DataFrame:
    """The documents with every found span (overlaps joined) replaced by ``mask``."""
    s = fresh(docs, "secrets")
    found = find_secrets(docs, text_col, s, fdr)
    cut = F.arrow_udf(_cut(mask), "string")
    return found.withColumn(text_col, F.when(F.size(col(s)) > 0, cut(col(text_col), col(s)))
                            .otherwise(col(text_col))).drop(s)


def _cut(mask: str):
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([replace_spans(t.as_py(), s.as_py(), mask) for t, s in zip(texts, spans)], pa.string())
    return cut


def replace_spans(text: str | None, spans: list[dict] | None, mask: str) -> str | None:
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for x in spans:
        if x["start"] >= end:
            out += [text[at:x["start"]], mask]
            end = x["end"]
        end = max(end, x["end"])
        at = end
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    workers_import(spark)
    stored = materialize(docs.select("doc_id", scan(col("text")).alias("scan")), "secrets")
    at_least = thresholds(stored.select(col("scan")["tests"].alias("tests")), "tests", FDR)
    found = _decided(stored, "scan", "secrets", at_least)
    base = F.filter(col("secrets"), lambda x: x["kind"] < len(KINDS))
    n = lambda k: F.size(F.filter(col("secrets"), lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(col("secrets")).alias("spans"))
