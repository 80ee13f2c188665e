r"""Grouping of spelling variants by PartEnum signatures.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  The form of a word is its near word of largest count (ties: the
smallest in code-point order), if that count is at least twice the word's own; its
root is what following forms ends at.

1. *Counts*: runs of letters are counted per document and combined in each task before
   they are shuffled.
2. *Vectors*: a word is cut in two halves, and the letter multiset of a half is a binary
   vector with one dimension for each (letter, occurrence).  An edit leaves one half as it is
   and moves the other one's vector by a Hamming distance of one (inserted or
   deleted letter) or two (replaced letter).
3. *Partition and enumerate*: the dimensions of the half that may have changed are dealt
   into PARTS parts; a signature is the half that stays, spelled out, with all parts but
   those that may differ: one part, or two.  Where two parts differ, one word has a
   letter more in the first part and one less in the second, so signatures of words in
   the two roles are joined, not all words of a group.
4. *Equi-join* on the signatures' 64-bit digests, and *verification* by edit distance.
   Signatures hold the order of the letters of a half and the lengths, so common letters do not
   gather in one group, and a group that is large all the same is split by the join.  Nothing
   is broadcast: all tables grow with the words.
5. *Roots*: forms are followed by doubling.  Counts double with each form, so
   log2 of the largest count bounds the rounds.

Defined results: null and empty texts have no words; rows without an id count (their id is
empty text in the checksum); repeated rows count as often as they stand there; an empty table
gives no words.  Input columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import col, read_table, slices
from strata.llm.periodic_runs import SQL_CRC, SQL_CRC_TABLE
from strata.session import discard, materialize

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Parts that the dimensions of a half are dealt into.
PARTS = 3
#: Different words that a counting task holds before it sends them on.
HELD = 200_000


def _count(rows: Iterator[pa.RecordBatch], noise: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for batch in slices(rows):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(LETTERS.findall((text or "").translate(LOWER))).items():
                if noise:
                    h = zlib.crc32(f"{i or ''}:{word}".encode())
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                held[word] += n
            if len(held) >= HELD:
                yield sent()
    yield sent()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 0,
                least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """word, n of the runs of letters (A-Z in lower case) of at least ``least_chars`` code points that occur
    ``least_count`` times or more.  ``noise``: in one of so many pairs of document and word, the word
    loses a letter (where it divides h, crc32 of ``id:word``; letter h modulo its length); 0 for none."""
    rows = docs.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text"))
    part = rows.mapInArrow(lambda batches: _count(batches, noise), "word string, n long")
    return (part.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.sum("n").alias("n"))
                .where(F.col("n") >= least_count))


def _parts(half: str) -> tuple[list[str], list[int]]:
    """The dimensions of a half, part by part: as text, and their number."""
    seen: dict[str, int] = {}
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for c in sorted(half):
        k = seen[c] = seen.get(c, -1) + 1
        parts[(ord(c) + k) % PARTS].append(f"{c}{k}")
    return ["".join(p) for p in parts], [len(p) for p in parts]


def signatures(word: str, longer: bool) -> Iterator[str]:
    """Signatures of a word.  ``longer``: in the role of the word that has the letter more (of an inserted
    letter, or in the first of two parts); two near words have a signature in common, one in either role."""
    n = len(word)
    h = n // 2
    for side, stays, changed in (("a", word[:h], word[h:]), ("z", word[h:], word[:h])):
        p, sizes = _parts(changed)
        for i in range(PARTS):  # a letter replaced by one of the same part
            yield f"{side}{n} {stays} {i} " + " ".join(p[:i] + p[i + 1:])
        for i, j in combinations(range(PARTS), 2):  # a letter of part i replaced by one of part j
            if sizes[i if longer else j]:
                rest = " ".join(p[k] for k in range(PARTS) if k not in (i, j))
                yield f"{side}{n} {stays} {i}{j} {sizes[i] - longer} {rest}"
    if not longer:
        for side, stays, changed in (("a", word[:h], word[h:]), ("z", word[h:], word[:h])):
            p, _ = _parts(changed)
            for i in range(PARTS):
                yield f"{side}{n}+ {stays} {i} " + " ".join(p[:i] + p[i + 1:])
    else:
        h = (n - 1) // 2
        for side, stays, changed in (("a", word[:h], word[h:]), ("z", word[h + 1:], word[:h + 1])):
            p, sizes = _parts(changed)
            for i in range(PARTS):
                if sizes[i]:
                    yield f"{side}{n - 1}+ {stays} {i} " + " ".join(p[:i] + p[i + 1:])


def _signed(rows: Iterator[pa.RecordBatch], longer: bool) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in slices(rows, 2048):
        words, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sig, word, n = [], [], []
        for w, k in zip(words, ns):
            own = {digest(s.encode()) - (1 << 63) for s in signatures(w, longer)}
            sig.extend(own)
            word.extend([w] * len(own))
            n.extend([k] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["sig", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of near words of (word, n), each once: word, n, other, n_other with word < other."""
    side = lambda longer: words.select("word", "n").mapInArrow(lambda rows: _signed(rows, longer), "sig long, word string, n long")
    x, y = side(True).alias("x"), side(False).alias("y")
    # by shuffle at every size: Spark takes the signatures for as large as the words that they are made of
    met = x.join(y.hint("merge"), (F.col("x.sig") == F.col("y.sig")) & (F.levenshtein("x.word", "y.word", 1) == 1))
    first = F.col("x.word") < F.col("y.word")
    a, b = F.struct("x.word", "x.n"), F.struct("y.word", "y.n")
    pair = met.select(F.when(first, a).otherwise(b).alias("a"), F.when(first, b).otherwise(a).alias("b"))
    return pair.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("n_other")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row of (word, form), no form null: the last word on the way of forms, which has no circles."""
    up = materialize(forms.select("word", col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not up.where("moved").isEmpty():
        on = up.select(col("word").alias("w"), col("root").alias("r"))
        ahead = up.join(on.hint("merge"), up["root"] == on["w"], "left").select(
            "word", F.coalesce("r", "root").alias("root"), col("r").isNotNull().alias("moved"))
        last, up = up, materialize(ahead, "roots")
        discard(last)
    return up.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """For each row of (word, n), words being distinct: word, form, root, n, n_near, form_n."""
    words = materialize(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("n").alias("own"), F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form")).alias("near")),
        F.struct(F.col("other").alias("word"), F.col("n_other").alias("own"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("near")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("own").alias("own"), F.min("near").alias("near"))
    known = F.when(-F.col("near.less") >= 2 * F.col("own"), F.col("near.form"))
    near = materialize(best.select("word", "n_near", known.alias("form"), F.when(known.isNotNull(), -F.col("near.less")).alias("form_n")), "near")
    last = roots(near.where("form is not null"))
    # what these tables have in files says little of what a broadcast of them takes
    return (words.join(near.hint("merge"), "word", "left").join(last.hint("merge"), "word", "left")
                 .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                         F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read_table(spark, sf_dir, "documents"), noise=97))


OP11_SQL = rf"""
WITH RECURSIVE {SQL_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
), h AS (
  SELECT run, n, {SQL_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT x.word, x.n, y.word AS other, y.n AS n_other FROM cuts x JOIN cuts y USING (i, cut) WHERE x.word <> y.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
), best AS (
  SELECT word, count(*) AS n_near, min(n) AS n, max(n_other) AS most FROM pairs GROUP BY word
), forms AS (
  SELECT b.word, min(p.other) AS form, most FROM best b JOIN pairs p ON p.word = b.word AND p.n_other = most WHERE most >= 2 * b.n GROUP BY b.word, most
), up AS (
  SELECT word, word AS root FROM words UNION SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.root
), roots AS (
  SELECT word, root FROM up WHERE root NOT IN (SELECT word FROM forms)
)
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.most::BIGINT AS form_n
FROM words w JOIN roots r USING (word) LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
"""
