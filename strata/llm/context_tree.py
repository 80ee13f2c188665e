"""Context-tree weighting over bytes, and add-one unigram scores beside it.

*Model*: a text is its bytes (A-Z in lower case) and an end mark, 0xFF.  A byte is eight
binary decisions along its bits; each of the 255 decision places has a context tree
of its own over the preceding bytes.  A node's counts give a
Krichevsky-Trofimov estimate, and its weighted probability is half that of
stopping there plus half the product over its children, so every depth is mixed
by how well it coded the training bytes.  The query mixes depths 0 to
``context_depths.DEPTH`` = 6 (``score_deep``; that module says how); what follows is the
small model of depth ``DEPTH`` = 2, which fits a broadcast (``score``).

*Training*: tasks send byte trigrams and words with their counts, combined twice, so
what is gathered follows the vocabulary of the corpus, never one task or the driver.
The leaves' and the middle nodes' weights are found per last byte (at most 65,536
rows each); 256 rows of these meet at the driver, for the root.

*Scoring*: the code length of a byte depends on the two bytes before it alone, so the model
is one row of 256 log-probabilities per seen context: 65,536 KB at most, whatever
the corpus, which is broadcast.  A context that training never saw has no node;
there the tree ends at its deepest seen node.

*Unigrams*: words with at least one in ``FREQUENT`` of all tokens, of which there
are ``FREQUENT`` at most, are broadcast; the others of each document are joined
with their counts.

Defined results: null text is empty (one token, the end); rows without an id are
training rows; an empty training set leaves each bit at one half and each base
score at the smoothing's value; repeated rows are each scored (and learned from);
texts are read whole.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import context_depths
from strata.llm.common import col, id_part, read_table, slices, workers_import
from strata.session import materialize

DEPTH = 2
END = 0xFF
#: At most so many words are broadcast: those that make up one in so many tokens.
FREQUENT = 1 << 20
#: Entries that a task's counters hold before they are sent on.
HELD = 1 << 19
_LOWERED = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED)


def trigrams(data: bytes) -> np.ndarray:
    """(two bytes before, byte) of every byte and of the end mark, as 24-bit codes."""
    b = np.frombuffer(b"\xff\xff" + data + b"\xff", np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series after eight steps of the recurrence."""
    y = x + 8
    inv = 1 / y
    series = inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - inv ** 7 / 1680
    steps = np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    return (y - .5) * np.log(y) - y + np.log(2 * np.pi) / 2 + series - np.log(steps)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence of n0 zeros and n1 ones."""
    n0, n1 = np.asarray(n0, float), np.asarray(n1, float)
    return np.where(n0 + n1 > 0, log_gamma(n0 + .5) + log_gamma(n1 + .5) - log_gamma(n0 + n1 + 1) - np.log(np.pi), 0.0)


def decisions(symbols: np.ndarray) -> np.ndarray:
    """Counts of 256 symbols -> counts of the 512 nodes of their binary tree (node 1 is the
    root, the children of u are 2u and 2u + 1, symbol s is node 256 + s)."""
    out = np.zeros((*symbols.shape[:-1], 512), np.int64)
    out[..., 256:] = symbols
    for u in range(7, -1, -1):
        width = 1 << u
        out[..., width:2 * width] = out[..., 2 * width:4 * width].reshape(*symbols.shape[:-1], width, 2).sum(axis=-1)
    return out


def _split(tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 256 inner nodes (node 0 has none)."""
    zeros, ones = tree[..., 0::2].copy(), tree[..., 1::2].copy()
    zeros[..., 0] = ones[..., 0] = 0
    return zeros, ones


def _one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Probability that the next decision is a one."""
    return (n1 + .5) / (n0 + n1 + 1)


def weigh(n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, share of stopping here) of inner nodes, from the sum of their
    children's ln weighted probabilities."""
    stop = log_kt(n0, n1)
    weighted = np.logaddexp(stop, children) - np.log(2)
    return weighted, np.exp(stop - np.log(2) - weighted)


def leaf_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Seen second-last bytes and their 256 symbol counts, of trigrams with one last byte."""
    before = pdf["gram"].to_numpy() >> 16
    seen, at = np.unique(before, return_inverse=True)
    symbols = np.zeros((len(seen), 256), np.int64)
    np.add.at(symbols, (at, pdf["gram"].to_numpy() & 255), pdf["n"].to_numpy())
    return seen, symbols


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per last byte: decision counts and ln weighted probabilities of its nodes."""
    _, symbols = leaf_rows(pdf)
    leaves = log_kt(*_split(decisions(symbols))).sum(axis=0)
    tree = decisions(symbols.sum(axis=0))
    weighted, _ = weigh(*_split(tree), leaves)
    return pd.DataFrame({"last": [int(pdf["last"].iloc[0])], "tree": [tree.tobytes()], "weighted": [weighted.tobytes()]})


def symbol_logs(ones: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol from the probability of a one at each inner node."""
    out = np.zeros((*ones.shape[:-1], 512))
    logs = np.empty_like(out)
    with np.errstate(divide="ignore"):
        logs[..., 1::2], logs[..., 0::2] = np.log10(ones), np.log10(1 - ones)
    for u in range(8):
        width = 1 << u
        out[..., 2 * width:4 * width] = np.repeat(out[..., width:2 * width], 2, axis=-1) + logs[..., 2 * width:4 * width]
    return out[..., 256:]


def mixed(root_one: np.ndarray, root_stop: np.ndarray, symbols: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Symbol logs after one last byte: (of contexts never seen before it, of each seen one).

    ``symbols``: counts after each seen second-last byte; None if the last byte was never seen."""
    if symbols is None:
        return symbol_logs(root_one), np.zeros((0, 256))
    leaf0, leaf1 = _split(decisions(symbols))
    n0, n1 = _split(decisions(symbols.sum(axis=0)))
    _, stop = weigh(n0, n1, log_kt(leaf0, leaf1).sum(axis=0))
    here = _one(n0, n1)
    deeper = np.where(leaf0 + leaf1 > 0, stop * here + (1 - stop) * _one(leaf0, leaf1), here)
    under = np.where(n0 + n1 > 0, 1, 0)
    from_root = lambda p: np.where(under, root_stop * root_one + (1 - root_stop) * p, root_one)
    return symbol_logs(from_root(here)), symbol_logs(from_root(deeper))


def _rows(shared):
    """Per last byte: one row of symbol logs per seen context, and one (before = -1) for the others."""
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        root_one, root_stop = shared.value
        seen, symbols = leaf_rows(pdf)
        other, each = mixed(root_one, root_stop, symbols)
        last = int(pdf["last"].iloc[0])
        logs = [other, *each]
        return pd.DataFrame({"last": [last] * len(logs), "before": [-1, *seen.tolist()],
                             "logs": [x.astype(np.float32).tobytes() for x in logs]})
    return rows


@dataclass(frozen=True)
class Model:
    """Row of ``logs`` for each of the 65,536 contexts."""

    place: np.ndarray
    logs: np.ndarray

    def score(self, data: bytes) -> float:
        """log10 probability of the bytes and the end mark."""
        code = trigrams(data)
        return float(self.logs[self.place[code >> 8], code & 255].sum(dtype=np.float64))

    def bits_per_byte(self, data: bytes) -> float:
        return -self.score(data) / np.log10(2) / (len(data) + 1)


def _word_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As below, without the trigrams."""
    return _statistics(batches, False)


def _statistics(batches: Iterator[pa.RecordBatch], contexts: bool = True) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams (gram) and words (word) of the texts; gram -1 counts texts."""
    def sent(grams: np.ndarray, n: np.ndarray, words: Counter) -> pa.RecordBatch:
        k = len(grams)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[grams, np.zeros(len(words), np.int64)], mask=np.r_[np.zeros(k, bool), np.ones(len(words), bool)]),
             pa.array([None] * k + list(words), pa.binary()),
             pa.array(np.r_[n, np.fromiter(words.values(), np.int64, len(words))])], ["gram", "word", "n"])

    words, docs, held, size = Counter(), 0, [], 0
    grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge() -> None:
        nonlocal grams, n, held, size
        if held:
            new, count = np.unique(np.concatenate(held), return_counts=True)
            grams, at = np.unique(np.r_[grams, new.astype(np.int64)], return_inverse=True)
            n = np.bincount(at, np.r_[n, count], len(grams)).astype(np.int64)
            held, size = [], 0

    for batch in slices(batches):
        for t in batch.column(0):
            data = lowered(t.as_py())
            words.update(data.split())
            if contexts:
                held.append(trigrams(data))
            docs, size = docs + 1, size + len(data)
        if size >= 1 << 22:
            merge()
        if len(words) >= HELD:
            yield sent(np.zeros(0, np.int64), np.zeros(0, np.int64), words)
            words = Counter()
    merge()
    yield sent(np.r_[-1, grams], np.r_[docs, n], words)


def statistics(train: DataFrame, text_col: str = "text", contexts: bool = True) -> DataFrame:
    """gram (24-bit code, if ``contexts``; -1: texts) or word, and n, over all training rows; stored once."""
    workers_import(train.sparkSession)
    s = train.select(col(text_col)).mapInArrow(_statistics if contexts else _word_statistics, "gram long, word binary, n long")
    return materialize(s.groupBy("gram", "word").agg(F.sum("n").alias("n")), "statistics")


def tree_model(stats: DataFrame) -> Model:
    """The weighted context trees of all bytes."""
    spark = stats.sparkSession
    grams = stats.where("gram >= 0").select("gram", "n", F.shiftright("gram", 8).bitwiseAND(255).cast("int").alias("last"))
    middle = grams.groupBy("last").applyInPandas(_middle, "last int, tree binary, weighted binary").collect()
    tree = np.sum([np.frombuffer(r.tree, np.int64) for r in middle], axis=0) if middle else np.zeros(512, np.int64)
    below = np.sum([np.frombuffer(r.weighted) for r in middle], axis=0) if middle else np.zeros(256)
    n0, n1 = _split(tree)
    _, stop = weigh(n0, n1, below)
    one = _one(n0, n1)
    shared = spark.sparkContext.broadcast((one, stop))
    rows = grams.groupBy("last").applyInPandas(_rows(shared), "last int, before int, logs binary").collect()
    logs = [symbol_logs(one)]
    place = np.zeros(1 << 16, np.int32)  # contexts are before << 8 | last
    for r in sorted(rows, key=lambda r: r.before):
        contexts = np.arange(256) << 8 | r.last if r.before < 0 else r.before << 8 | r.last
        place[contexts] = len(logs)
        logs.append(np.frombuffer(r.logs, np.float32))
    return Model(place, np.array(logs, np.float32))


def _counted(texts: list[bytes], score: list[float], known: dict[bytes, float]) -> pa.StructArray:
    """Texts' scores, tokens, and of frequent words: how many, and their log10(c + 1);
    the other words with their counts."""
    rows = []
    for data in texts:
        words = Counter(data.split())
        often = {w: n for w, n in words.items() if w in known}
        rows.append((sum(words.values()) + 1, sum(often.values()),
                     float(sum(n * known[w] for w, n in often.items())),
                     [(w, n) for w, n in words.items() if w not in often]))
    tokens, n, logs, rare = zip(*rows) if rows else ([],) * 4
    ends = np.cumsum([0, *map(len, rare)])
    flat = [x for r in rare for x in r]
    pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()),
                                        pa.array([k for _, k in flat], pa.int32())], ["word", "k"])
    return pa.StructArray.from_arrays(
        [pa.array(score, pa.float64()), pa.array(tokens, pa.int64()), pa.array(n, pa.int64()),
         pa.array(logs, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
        ["score", "n_tokens", "n_often", "logs", "rare"])


def _scored(shared):
    """texts -> as ``_counted``."""
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = shared.value
        for batch in slices(texts):
            data = [lowered(t.as_py()) for t in batch]
            yield _counted(data, [model.score(x) for x in data], known)
    return scored


_SCORED = "score double, n_tokens long, n_often long, logs double, rare array<struct<word:binary,k:int>>"


class _Unigrams:
    """Words of the training texts: those that are broadcast, the others, and the totals."""

    def __init__(self, stats: DataFrame):
        words = stats.where("word is not null")
        n_words, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.texts = stats.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.tokens, self.vocabulary = total + self.texts, n_words + (self.texts > 0)
        frequent = F.col("n") >= -(-self.tokens // FREQUENT)  # so there are FREQUENT at most
        self.known = {bytes(w): float(np.log10(n + 1))
                      for w, n in words.where(frequent).select("word", "n").toPandas().itertuples(index=False)}
        self.rare = words.where(~frequent)

    def finished(self, done: DataFrame, id_col: str) -> DataFrame:
        # words that are not frequent: those that training lacks add nothing
        rare = done.select("row", F.inline("rare")).join(self.rare, "word").groupBy("row").agg(
            F.sum("k").alias("n_rare"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs_rare"))
        zero = F.lit(0).cast("long")
        end = (self.texts > 0, float(np.log10(self.texts + 1)))
        return done.join(rare, "row", "left").select(
            F.col("id").alias(id_col), "n_tokens",
            (F.col("n_often") + F.coalesce("n_rare", zero) + int(end[0])).cast("long").alias("n_known"),
            F.lit(self.tokens).cast("long").alias("train_tokens"),
            (F.col("logs") + F.coalesce("logs_rare", F.lit(0.0)) + F.lit(end[1])
             - F.col("n_tokens") * F.lit(float(np.log10(self.tokens + self.vocabulary + 1)))).alias("base_score"), "score")


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_tokens, n_known, train_tokens, base_score, score; contexts of ``DEPTH`` bytes."""
    stats = statistics(train, text_col)
    unigrams = _Unigrams(stats)
    shared = docs.sparkSession.sparkContext.broadcast((tree_model(stats), unigrams.known))
    udf = F.arrow_udf(_scored(shared), _SCORED)
    done = materialize(docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"),
                                   udf(col(text_col)).alias("s")).select("row", "id", "s.*"), "scored")
    return unigrams.finished(done, id_col)


def score_deep(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text",
               depth: int = context_depths.DEPTH) -> DataFrame:
    """As ``score``, of contexts of up to ``depth`` bytes, learned from the rows where ``trained`` is true."""
    unigrams = _Unigrams(statistics(docs.where(trained), text_col, contexts=False))
    shared = docs.sparkSession.sparkContext.broadcast(unigrams.known)
    done = context_depths.scored(docs, trained, lambda texts, scores: _counted(texts, scores, shared.value), _SCORED,
                                 id_col, text_col, depth)
    return unigrams.finished(done, id_col)


def held_out(c: Column) -> Column:
    """The contract's test rows: crc32 of the id modulo 7 is 2 (a null id is none)."""
    return F.coalesce(id_part(c, 7) == 2, F.lit(False))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    s = score_deep(docs, ~held_out(col("doc_id")))
    return s.select("doc_id", held_out(col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score")
