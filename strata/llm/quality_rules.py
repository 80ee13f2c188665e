"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document.  The ledger row holds the
measurements and one bit per failed rule; a *policy* is a named, versioned
mask over those bits, so applying another policy, comparing two of them or
asking what one rule alone removes never reads the texts again.

Defined results: a null text has no words (all measurements 0) and fails
``few_words``; an empty table gives an empty ledger; repeated rows are each
judged on their own; long texts are measured whole.  Columns of the input other
than the id and the text are not read, whatever their names.

*What a text says*: ``listed_words`` fails where more than one word in 200 is in a list
given by the caller (none: no document fails).  ``toxic_words`` learns such a list
from labelled documents: whole words of four or more letters in at least four toxic
documents of the sample, and in one other for every nine of those at most.  The sample is
the ``LABELLED`` labels least by hash of their id, without the ids held out for figures
(crc32 of the id modulo 4 is 2); no id is otherwise looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import SPACES, ascii_lower, col, fresh, id_part, read_table, slices, workers_import

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
            "n_repeat_words", "n_letters", "n_upper", "n_exclaim", "n_listed")

#: Labels that a word list is learned from, at most.
LABELLED = 20_000
#: Signs cut from both ends of a word before it is looked up.
_AROUND = ".,;:!?\"'()"
_LOWERED = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))

_SYMBOLS = b"#*$%&|<>"
_SPACE_BYTES = SPACES.encode()
_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_UPPER = bytes(range(0x41, 0x5B))
#: Deleting these leaves ASCII letters and one lead byte per other character.
_NOT_LETTERS = bytes(b for b in range(256) if b < 0xC0 and b not in _LETTERS)
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` (a condition on its measurements) is true."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


#: The order fixes the bits: rules are only ever added at the end.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("word_length", lambda m: ~m["word_chars"].between(2 * m["n_words"], 40 * m["n_words"])),
    Rule("few_letters", lambda m: 100 * m["n_letters"] < 50 * m["word_chars"]),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 60 * m["n_letters"]),
    Rule("exclamations", lambda m: 100 * m["n_exclaim"] > 50 * m["n_words"]),
    Rule("listed_words", lambda m: 200 * m["n_listed"] > m["n_words"]),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what is asked of a document: the rules that must not fail."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", (*BASE.rules, "symbols", "duplicate_lines"))
V2 = Policy("v2", (*V1.rules, "word_length", "few_letters", "shouting", "exclamations"))
V3 = Policy("v3", (*V2.rules, "listed_words"))


def repeat_words(words: Sequence[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    v = len(seen)
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # keep the product of the three within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    keys = pair[:-1] * v + ids[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= hit
    return int(covered.sum())


def n_listed(data: bytes, listed: frozenset[bytes]) -> int:
    """Words of the text that are listed (in lower case, without the signs around them)."""
    if not listed:
        return 0
    around = _AROUND.encode()
    return sum(w.strip(around) in listed for w in data.translate(_LOWERED).split())


def measure(text: str | None, listed: frozenset[bytes] = frozenset()) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly the white space of SPACES
    solid = data.translate(None, _SPACE_BYTES)
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    return (
        len(words),
        len(solid.translate(None, _CONTINUATION)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(data.translate(None, _NOT_LETTERS)),
        len(data.translate(None, _NOT_UPPER)),
        data.count(b"!"),
        n_listed(data, listed),
    )


def _measured(listed: frozenset[bytes]):
    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(texts):
            rows = np.array([measure(t.as_py(), listed) for t in batch], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], list(MEASURES))
    return measured


def measures(text: Column, listed: frozenset[bytes] = frozenset()) -> Column:
    """One struct of measurements per text."""
    udf = F.arrow_udf(_measured(listed), ", ".join(f"{m} long" for m in MEASURES))
    return udf(text)


def toxic_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> frozenset[bytes]:
    """Words that toxic documents of the labelled sample have and others hardly have.
    Ids without a label don't count."""
    learn = F.coalesce(id_part(col(id_col), 4) != 2, F.lit(False)) & col("toxic").isNotNull()
    known = (labels.where(learn).groupBy(col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("id"), "id").limit(LABELLED))
    words = F.transform(F.split(ascii_lower(F.coalesce(col("text"), F.lit(""))), f"[{SPACES}]+"),
                        lambda w: F.btrim(w, F.lit(_AROUND)))
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(known), "id")
    seen = texts.select("toxic", F.explode(F.array_distinct(words)).alias("word")).where(F.length("word") >= 4)
    n = seen.groupBy("word").agg(F.count_if(col("toxic") > 0).alias("toxic"), F.count("*").alias("n"))
    rows = n.where((col("toxic") >= 4) & (10 * col("toxic") >= 9 * col("n"))).select("word")
    return frozenset(r.word.encode() for r in rows.collect())


def _bits(m: Mapping[str, Column]) -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(m), BIT[rule.name]).otherwise(0).cast("long"))
    return bits


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                listed: frozenset[bytes] = frozenset()) -> DataFrame:
    """One row per document: the id, every measurement, ``fail_bits``.

    One pass over the texts, no shuffle."""
    workers_import(docs.sparkSession)
    m = docs.select(col(id_col).alias(id_col), measures(col(text_col), listed).alias("m"))
    flat = m.select(id_col, *[col("m").getField(k).alias(k) for k in MEASURES])
    return flat.withColumn("fail_bits", _bits({k: flat[k] for k in MEASURES}))


def apply_policy(ledger: DataFrame, policy: Policy = V2, out: str = "kept") -> DataFrame:
    """``out``: true where no rule of the policy fails.  Reads the bits alone."""
    return ledger.withColumn(out, col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablation(ledger: DataFrame, policy: Policy = V2) -> DataFrame:
    """Per rule of the policy: documents that fail it (``n_failed``), that fail no
    other rule of the policy (``n_only``), and that the policy keeps without the
    rule (``n_kept_without``).

    The ledger is first counted by distinct bit pattern (at most 2 ** rules
    rows, combined before the shuffle); all else is bit arithmetic on those."""
    mask = F.lit(policy.mask).cast("long")
    seen = ledger.groupBy(col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                      for r in policy.rules])
    rows = seen.select("bits", "n", F.inline(rules))
    bits, bit, n = rows["bits"], rows["bit"], rows["n"]
    count = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    return rows.groupBy("rule").agg(
        count(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        count(bits == bit).alias("n_only"),
        count(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"))


def keep_good(docs: DataFrame, policy: Policy = V2, text_col: str = "text",
              listed: frozenset[bytes] = frozenset()) -> DataFrame:
    """The documents that the policy keeps, with all the columns they came with."""
    workers_import(docs.sparkSession)
    m = fresh(docs, "ledger")
    d = docs.withColumn(m, measures(col(text_col), listed))
    bits = _bits({k: col(m).getField(k) for k in MEASURES})
    return d.where(bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0).drop(m)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of ``documents`` with the word list that ``labels`` teach, ``kept`` by policy V3 and ``v2_kept``."""
    docs = read_table(spark, sf_dir, "documents")
    listed = toxic_words(docs, read_table(spark, sf_dir, "labels"))
    return apply_policy(apply_policy(rule_ledger(docs, listed=listed), V3), V2, "v2_kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = apply_policy(_judged(spark, sf_dir), BASE, "base_kept")
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~col("base_kept")).alias("base_failed"), "kept", "n_listed", "fail_bits",
                       F.lit(V3.version).alias("policy"))


def op9_toxic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what the policy without the word list says."""
    base = apply_policy(_judged(spark, sf_dir), BASE, "base_kept")
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~col("base_kept")).alias("base_failed"), "kept", "n_listed", "v2_kept", "fail_bits",
                       F.lit(V3.version).alias("policy"))


def op9_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy removes, alone and beside the others."""
    return ablation(_judged(spark, sf_dir), V3)
