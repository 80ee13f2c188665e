r"""Periodic runs of words: longest common extensions over a difference cover drive a
harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least
max(6, 4q) words long, that no neighbouring word extends keeping that period.

1. *Grid*: a run of period p and 4p words or more holds both i and i + p for some i
   on the grid 0, 3p, 6p, ...; such pairs of equal words are taken for every p up to a
   quarter of a text, n log n places in all.
2. *Few words*: both words' neighbours are compared one by one, for as many words as it
   can take to reach synchronised samples.  Most pairs part there.
3. *Difference cover*: the texts in which a pair is still equal are ranked: only
   suffixes that start on a cover of residues modulo 31 are sorted (blocks of 31 words
   first, then doubled), with the common prefixes of neighbours in a sparse table.  For any
   two places some distance below 31 brings both onto the cover, so an extension is
   those few words and one range minimum.  Texts read backwards give the other side.
4. *Runs*: the extensions to both sides give the whole stretch.  A stretch found with
   several periods keeps the smallest, which divides the others.

Texts are handled in bounded batches of whole texts, without a shuffle; a text of its own
takes n log n time and some 200 bytes a word.

Defined results: a null text, an empty one and one of white space have no words and no
runs; rows without an id and repeated rows are each reported; an empty table gives no rows.
Input columns other than id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import col, id_part, read_table, slices

#: A perfect difference set: every residue modulo 31 is a difference of two of these (fixed values).
COVER_MOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Least words of a run, and least number of its periods.
LEAST, TIMES = 6, 4
#: Words that are searched together, unless a single text has more.
BATCH_WORDS = 1 << 18


def _shifts() -> np.ndarray:
    """shift[a, b]: least number of words that brings places of residues a and b onto the cover."""
    on = np.zeros(COVER_MOD, bool)
    on[list(COVER)] = True
    r = np.arange(COVER_MOD)
    both = on[(r[:, None, None] + r) % COVER_MOD] & on[(r[None, :, None] + r) % COVER_MOD]
    return both.argmax(axis=2)


SHIFT = _shifts()


def matching(w: np.ndarray, i: np.ndarray, j: np.ndarray, limit) -> np.ndarray:
    """Number of equal words from places i and j on, ``limit`` (a number, or one for each pair) at most."""
    out = np.zeros(len(i), np.int64)
    limit = np.broadcast_to(limit, len(i))
    live = np.flatnonzero(limit > 0)
    k = 0
    while len(live):
        live = live[w[i[live] + k] == w[j[live] + k]]
        k += 1
        out[live] = k
        live = live[limit[live] > k]
    return out


class Extensions:
    """Longest common extensions of places of ``w``, whose last word occurs once."""

    def __init__(self, w: np.ndarray):
        self.w = w
        self.at = np.flatnonzero(np.isin(np.arange(len(w)) % COVER_MOD, COVER))
        self.row = np.full(len(w), -1, np.int64)
        self.row[self.at] = np.arange(len(self.at))
        levels = self._levels()
        self.rank = levels[-1]
        order = np.empty(len(self.at), np.int64)
        order[self.rank] = np.arange(len(self.at))
        self.table = self._minima(self._neighbours(levels, order))

    def _levels(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first 31, 62, 124, ... words, until all differ."""
        padded = np.concatenate([self.w, np.zeros(COVER_MOD, self.w.dtype)])
        blocks = np.lib.stride_tricks.sliding_window_view(padded, COVER_MOD)[self.at]
        keys = np.ascontiguousarray(blocks.astype(">u4")).view(np.dtype((np.void, 4 * COVER_MOD))).ravel()
        levels = [np.unique(keys, return_inverse=True)[1].astype(np.int64)]
        step, m = COVER_MOD, len(self.at)
        while levels[-1].max(initial=-1) + 1 < m:
            rank = levels[-1]
            to = self.at + step
            after = np.where(to < len(self.w), rank[self.row[np.minimum(to, len(self.w) - 1)]], -1)
            levels.append(np.unique(rank * (m + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
            step *= 2
        return levels

    def _neighbours(self, levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common words of each sampled suffix and the one before it in order."""
        a, b = self.at[order[:-1]].copy(), self.at[order[1:]].copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][self.row[a]] == levels[k][self.row[b]]
            out[same] += COVER_MOD << k
            a[same] += COVER_MOD << k
            b[same] += COVER_MOD << k
        return out + matching(self.w, a, b, COVER_MOD)

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        table, span = [common], 1
        while 2 * span <= len(common):
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
            span *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFT[i % COVER_MOD, j % COVER_MOD]
        out = matching(self.w, i, j, shift)
        on = np.flatnonzero(out == shift)
        x, y = self.rank[self.row[i[on] + shift[on]]], self.rank[self.row[j[on] + shift[on]]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            here = level == k
            t = self.table[k]
            out[on[here]] += np.minimum(t[lo[here]], t[hi[here] - (1 << k)])
        return out


def grid(w: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods p of the harmonic grid with w[i] = w[i + p]."""
    places, periods = [], []
    for p in range(1, longest // TIMES + 1):
        step = (TIMES - 1) * p
        i = np.flatnonzero(w[:-p:step] == w[p::step]) * step
        if len(i):
            places.append(i)
            periods.append(np.full(len(i), p, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _sides(w: np.ndarray, i: np.ndarray, p: np.ndarray, extend, extend_back) -> tuple[np.ndarray, np.ndarray]:
    n = len(w)
    return extend(i, i + p), extend_back(n - i, n - i - p)


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, sorted by start, then period; a text is an array of word numbers from 1 on."""
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes + 1)  # each text ends with a word of its own, as the first begins after one
    top = max([0, *(int(t.max()) for t in texts if len(t))])
    w = np.zeros(int(end[-1]) + 1 if len(texts) else 1, np.int64)
    w[0] = top + 1
    for k, t in enumerate(texts):
        w[end[k] - sizes[k]:end[k]] = t
        w[end[k]] = top + 2 + k
    i, p = grid(w, int(sizes.max(initial=0)))
    within = i + p < end[np.searchsorted(end, i)]
    i, p = i[within], p[within]
    few = lambda a: lambda x, y: matching(a, x, y, COVER_MOD)
    ahead, back = _sides(w, i, p, few(w), few(w[::-1]))
    at = np.searchsorted(end, i)
    long = np.unique(at[(ahead == COVER_MOD) | (back == COVER_MOD)])
    found = {}
    short = ~np.isin(at, long)
    _collect(found, i[short], p[short], ahead[short], back[short], at[short], end - sizes)
    if len(long):
        _ranked(found, [texts[k] for k in long], long, i, p, at, end - sizes)
    out = [[] for _ in texts]
    for (k, start, length), q in found.items():
        out[k].append((start, length, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _ranked(found: dict, texts: list[np.ndarray], which: np.ndarray, i, p, at, first) -> None:
    """The same for the texts ``which``, in which some pair is equal beyond the few words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes + 1)
    top = max(int(t.max()) for t in texts)
    w = np.zeros(int(end[-1]) + 1, np.int64)
    w[0] = top + 1
    for k, t in enumerate(texts):
        w[end[k] - sizes[k]:end[k]] = t
        w[end[k]] = top + 2 + k
    w = np.unique(w, return_inverse=True)[1].astype(np.int64) + 1
    here = np.isin(at, which)
    i, p, at = i[here], p[here], at[here]
    own = i - first[at] + (end - sizes)[np.searchsorted(which, at)]
    ahead, back = _sides(w, own, p, Extensions(w), Extensions(w[::-1].copy()))
    _collect(found, i, p, ahead, back, at, first)


def _collect(found: dict, i, p, ahead, back, at, first) -> None:
    length = back + p + ahead
    keep = length >= np.maximum(LEAST, TIMES * p)
    for k, s, n, q in zip(at[keep].tolist(), (i - back - first[at])[keep].tolist(), length[keep].tolist(), p[keep].tolist()):
        found[k, s, n] = min(q, found.get((k, s, n), q))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between, without those that a run holds after its first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            edge[start + q] += 1
            edge[start + length] -= 1
        words = [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist()) if not inside]
    return b" ".join(words)


_OUT = [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string())]


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of texts, a bounded number of words at a time."""
    ids, texts, n = [], [], 0
    for batch in slices(rows):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().split()  # bytes are split at ASCII white space
            if ids and n + len(words) > BATCH_WORDS:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(words)
            n += len(words)
    if ids:
        yield ids, texts


def _search(rows: Iterator[pa.RecordBatch], id_type: pa.DataType, id_col: str) -> Iterator[pa.RecordBatch]:
    for ids, texts in _batches(rows):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = lambda: len(number) + 1
        runs = runs_of([np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts])
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[part], id_type), pa.array([len(t) for t in texts[part]], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs[part]], _OUT[1][1]),
                pa.array([collapsed(t, x).decode() for t, x in zip(texts[part], runs[part])], pa.string()),
            ], names=[id_col, *(n for n, _ in _OUT)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_words, runs (array of start, length, period, by start, then period) and
    collapsed (the text's words, one space between, without the repetitions)."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.select(col(id_col).alias("i")).schema[0].dataType
    arrow = to_arrow_type(kind)
    name = id_col.replace("`", "``")
    schema = f"`{name}` {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(col(id_col), col(text_col)).mapInArrow(lambda rows: _search(rows, arrow, id_col), schema)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where documents whose crc32 of the id is divisible by 10 end in a repetition: with
    n words and g = crc32 / 10, words from a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them.
    Null ids: as they are."""
    words = F.array_remove(F.split(col(text_col), r"[\x20\x09-\x0D]+"), "")
    g = F.floor(F.crc32(col(id_col).cast("string").cast("binary")) / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % F.nullif(n, F.lit(0))).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (g % 8 + 3))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    text = F.when(id_part(col(id_col), 10) == 0, F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(col(text_col))
    return docs.select(col(id_col), text.alias(text_col))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    top = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), col("top")["start"].alias("start"),
        (-col("top")["less"]).alias("length"), col("top")["period"].alias("period"),
        F.expr("-1000 * top.less div top.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


#: crc32 of a text in DuckDB: {0} is the text; ``crc_table`` must be at hand, as list t of its 256 entries.
SQL_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_concat([n], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)
)"""
SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295],
    list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""

OP13_SQL = rf"""
WITH {SQL_CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS d, doc_id, {SQL_CRC.format("doc_id::VARCHAR")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents, crc_table
), planted AS (
  SELECT d, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS yes, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS times FROM d
), words AS (
  SELECT d, n, i, w[1 + CASE WHEN yes AND i >= a THEN a + (i - a) % (1 + (n - a) // times) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planted)
), pairs AS (
  SELECT x.d, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.d = y.d AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT d, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY d, p ORDER BY i) AS island FROM pairs) GROUP BY d, p, island
), runs AS (
  SELECT d, start, length, min(p) AS period FROM stretches WHERE length >= greatest(6, 4 * p) GROUP BY ALL
), per AS (
  SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    min(struct_pack(less := -length, start := start, period := period)) AS top FROM runs GROUP BY d
), gone AS (
  SELECT DISTINCT d, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT d, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (d, i) GROUP BY d
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, (-top.less)::BIGINT AS length, top.period::BIGINT AS period,
  (1000 * -top.less // top.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (d) LEFT JOIN kept USING (d)
"""
