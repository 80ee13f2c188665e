"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader and calibrated by a temperature.

*Features*: letters in lower case, everything else one space; n-grams of one to three
characters, hashed into ``buckets``; 1 + log(tf), times the inverse document frequency
over all learnable documents, scaled to length one.

*Training*: on a sample of about ``per_language`` documents of each language (all of
them, where there are fewer), picked by a hash.  FTRL-proximal keeps, per
bucket and language, a sum of gradients and of their squares; the L1 penalty holds
weights at zero, the L2 penalty shrinks the rest.  The sample is dealt to ``shards``; in
each epoch every shard learns from the mean of all shards' states.  A tenth of the
sample isn't learned from but fits the temperature that makes scores probabilities.

Defined results: a null text and one without a letter are ``und`` with score 0, and
so is every text where nothing can be learned (an empty table, no language given);
with one language known, its score is 1; rows without an id can be learned from;
repeated rows count as often as they are there; texts are read whole.  Of other
columns only the language is read, for learning.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import col, fresh, id_part, read_table, slices, workers_import
from strata.session import materialize

UNKNOWN = "und"


@dataclass(frozen=True)
class Spec:
    """Sizes and rates of the learner.  ``per_language`` bounds the sample."""

    buckets: int = 1 << 15
    per_language: int = 1500
    shards: int = 8
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.01


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of the character n-grams of a text, one per place; none without a letter."""
    cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cps]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, cps, 32).astype(np.uint64)
    gap = np.r_[True, ~letter]  # one space for each run of other characters, and around
    c = np.r_[np.uint64(32), c, np.uint64(32)]
    keep = np.r_[True, letter, True]
    keep[1:-1] |= ~letter & ~gap[:-1]
    keep[-1] = letter[-1]
    c = c[keep]
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        h = (h[:len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64)


def counts(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and 1 + log of how often each occurs."""
    n = np.bincount(grams(text, buckets), minlength=buckets)
    at = np.flatnonzero(n)
    return at, 1 + np.log(n[at])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl_weights(z: np.ndarray, n: np.ndarray, s: Spec) -> np.ndarray:
    """Closed form of the penalised leader from the sums of a bucket."""
    w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
    return np.where(np.abs(z) > s.l1, w, 0.0)


def ftrl_pass(rows: Iterator[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray, s: Spec) -> None:
    """One pass over (class, buckets, values); ``z`` and ``n`` are changed in place.

    The last bucket of ``z`` and ``n`` is the bias."""
    for y, at, x in rows:
        at, x = np.r_[at, len(z) - 1], np.r_[x, 1.0]
        w = ftrl_weights(z[at], n[at], s)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
        n[at] = grown


@dataclass(frozen=True)
class Model:
    """Languages, weights (idf included) per bucket, bias, temperature."""

    spec: Spec
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return (x / np.sqrt((x * x).sum())) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, tf = counts(text, self.spec.buckets)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, tf) / self.temperature)
        i = int(p.argmax())
        return self.languages[i], float(p[i])


def _document_counts(buckets: int):
    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(buckets, np.int64), 0
        seen = np.zeros(buckets, bool)
        for batch in slices(batches):
            for t in batch.column(0):
                at = grams(t.as_py(), buckets)
                seen[at] = True
                df += seen
                seen[at] = False
                docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[docs, df[at]])], ["bucket", "n"])
    return document_counts


def _sparse(buckets: int):
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [counts(t.as_py(), buckets) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([a.astype(np.int32).tobytes() for a, _ in rows], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())], ["lang", "pick", "at", "tf"])
    return sparse


def _rows(pdf: pd.DataFrame, languages: tuple[str, ...], idf: np.ndarray):
    place = {x: i for i, x in enumerate(languages)}
    for lang, at, tf in zip(pdf["lang"], pdf["at"], pdf["tf"]):
        at = np.frombuffer(at, np.int32)
        x = np.frombuffer(tf, np.float32) * idf[at]
        yield place[lang], at, x / np.sqrt((x * x).sum())


def _epoch(shared, spec: Spec, languages: tuple[str, ...]):
    def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
        idf, z, n = shared.value
        z, n = z.copy(), n.copy()
        ftrl_pass(_rows(pdf.sort_values("pick"), languages, idf), z, n, spec)
        return pd.DataFrame({"z": [z.tobytes()], "n": [n.tobytes()]})
    return epoch


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross entropy, by golden section on its logarithm."""
    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]).mean())
    if not len(y):
        return 1.0
    a, b, r = -4.0, 3.0, (5 ** .5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(learnable: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          spec: Spec = Spec()) -> Model:
    """A model of the rows with a language.

    Document frequencies come from all rows, as (bucket, count) rows combined per
    task; the driver holds those of the buckets, the languages' counts, the states
    of the shards and the logits of the calibration rows: all bounded by ``spec``
    and the number of languages."""
    spark = learnable.sparkSession
    workers_import(spark)
    d = learnable.where(col(lang_col).isNotNull()).select(
        col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"),
        F.xxhash64(col(id_col), col(text_col)).alias("pick"))
    df = d.select("text").mapInArrow(_document_counts(spec.buckets), "bucket long, n long")
    totals = dict(df.groupBy("bucket").agg(F.sum("n")).collect())
    docs = totals.pop(-1, 0)
    idf = np.full(spec.buckets, 1 + np.log(1 + docs))
    at = np.fromiter(totals, np.int64, len(totals))
    idf[at] = 1 + np.log((1 + docs) / (1 + np.fromiter(totals.values(), np.int64, len(totals))))
    per_lang = dict(d.groupBy("lang").agg(F.count("*")).collect())
    languages = tuple(sorted(per_lang))
    k = len(languages)
    if not k:
        return Model(spec, (), idf, np.zeros((spec.buckets, 0)), np.zeros(0), 1.0)
    # about per_language rows of each language, by hash
    share = F.create_map(*[x for lang, n in per_lang.items()
                           for x in (F.lit(lang), F.lit(min(1.0, spec.per_language / n)))])
    sample = d.where(F.pmod("pick", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    sample = materialize(sample.select("lang", "text", "pick").mapInArrow(
        _sparse(spec.buckets), "lang string, pick long, at binary, tf binary").where("octet_length(at) > 0"), "sample")
    part = F.pmod(F.shiftright("pick", 32), F.lit(10 * spec.shards))
    learn = sample.where(part >= spec.shards).withColumn("shard", F.pmod(part, F.lit(spec.shards)))
    z, n = np.zeros((spec.buckets + 1, k)), np.zeros((spec.buckets + 1, k))
    for _ in range(spec.epochs):
        shared = spark.sparkContext.broadcast((idf, z, n))
        states = learn.groupBy("shard").applyInPandas(_epoch(shared, spec, languages), "z binary, n binary").collect()
        if states:
            z = np.mean([np.frombuffer(r.z).reshape(z.shape) for r in states], axis=0)
            n = np.mean([np.frombuffer(r.n).reshape(n.shape) for r in states], axis=0)
        shared.destroy()
    w = ftrl_weights(z, n, spec)
    model = Model(spec, languages, idf, w[:-1], w[-1], 1.0)
    logits, y = [], []
    shared = spark.sparkContext.broadcast(model)

    def held(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in pdfs:
            out = [(m.languages.index(lang), m.logits(np.frombuffer(a, np.int32), np.frombuffer(t, np.float32)).tolist())
                   for lang, a, t in zip(pdf["lang"], pdf["at"], pdf["tf"])]
            yield pd.DataFrame(out, columns=["y", "logits"])

    for r in sample.where(part < spec.shards).select("lang", "at", "tf").mapInPandas(
            held, "y int, logits array<double>").collect():
        y.append(r.y)
        logits.append(r.logits)
    t = _temperature(np.array(logits).reshape(-1, k), np.array(y, dtype=int))
    return Model(spec, languages, idf, w[:-1], w[-1], t)


def predictor(docs: DataFrame, model: Model):
    """Column function: text -> struct<lang, score>."""
    workers_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in slices(texts):
            out = [m.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()),
                                              pa.array([x for _, x in out], pa.float64())], ["lang", "score"])

    return F.arrow_udf(predict, "lang string, score double")


def held_out(c: Column) -> Column:
    """The contract's test rows: crc32 of the id modulo 4 is 2 (a null id is none)."""
    return F.coalesce(id_part(c, 4) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """``docs`` with a column ``out``: struct<lang, score>."""
    return docs.withColumn(out, predictor(docs, model)(col(text_col)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(col("doc_id"))))
    texts = docs.select("doc_id", "text")
    p = fresh(texts, "p")
    return identify(texts, model, out=p).select("doc_id", held_out(col("doc_id")).alias("held_out"),
                                                col(p)["lang"].alias("lang_pred"), col(p)["score"].alias("score"))
