"""Jaccard self-join on word n-grams by token-combination prefixes.

A document's set is its distinct n-gram hashes.  Equal sets form a class and only
one set of a class is joined.  With a similarity of at least t, a set of n tokens
misses at most e = n - ceil(t n) of them in its partner, so:

1. *Extended prefix*: the L = 2 e + 2 tokens of least hash.  Of two linked sets, the
   one whose prefix ends first shares at least L - e of it with the other's.
   Tokens that no other prefix has can't be shared; the rest fall in classes by
   the number of prefixes that have them.
2. *Rare tokens* (in ``rare`` prefixes at most) are indexed singly.  Sets that meet
   in them are counted pair by pair, a few for each token, and a pair is a
   candidate when it shares all that its frequent tokens can't make up for.
3. *Frequent tokens*: linked sets that share no rare token share L - e frequent ones.
   A set that has so many picks the least frequent of them until one signature at
   least must be shared: up to ``frequent`` prefixes a token is a signature; beyond,
   k tokens weigh k - 1 and their pairs are the signatures.  Sets of compatible
   size with a picked signature in their prefix are tied to one leader of it:
   rows stay linear in the prefixes, however many sets share the signature.
4. *Verification*: the whole sets of connected candidates are compared exactly, in
   blocks of bounded size; clusters of any size are dealt out over block pairs, those of
   a large one by size, as only sets of a size class and the next one can be linked.  A
   block pair returns a spanning forest of its links, and link counts, not pairs.  The block
   pairs grow with the square of a cluster, so they are worked off in as many passes as
   keep what is sent at a time in proportion to the sets.

Defined results: null or empty texts have an empty set, no links and themselves
as component; a null id has no component; an empty table gives an empty result;
repeated rows (same id and text) each get a row and count as copies; an id
identifies one text.  Texts are read whole.  Other input columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import (bitmap, col, fresh, in_bitmap, read_table, slices, slot, slots_of, without,
                               workers_import)
from strata.llm.components import components
from strata.session import discard, materialize


@dataclass(frozen=True)
class JoinSpec:
    """n-gram length, similarity in percent, prefixes up to which a token is rare,
    prefixes beyond which tokens are indexed by pairs, and sets and tokens in a block."""

    words: int = 3
    percent: int = 90
    rare: int = 16
    frequent: int = 12_000
    block: int = 1500
    tokens: int = 1_000_000


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_UPPER = bytes(range(0x41, 0x5B))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (each bit of the input moves each of the output)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def token_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams (all its words, when fewer)."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if not w:
        return np.zeros(0, np.int64)
    h = hash_array(np.array(w, dtype=object), categorize=False)
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = _mix(out * _ODD[i % len(_ODD)] + h[i:len(w) - k + 1 + i])
    return np.unique(out.view(np.int64))


def may_miss(n: Column | int, percent: int):
    """Tokens of a set of n that a linked set may lack."""
    return (n * (100 - percent) / 100).cast("int") if isinstance(n, Column) else n * (100 - percent) // 100


def prefix_length(n: int, percent: int) -> int:
    return min(n, 2 * may_miss(n, percent) + 2)


def _sketch(spec: JoinSpec):
    """ids, texts -> id, set size, digest of the set, prefix."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, prefix = [], [], []
            for t in batch.column(1):
                s = token_set(t.as_py(), spec.words)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                prefix.append(s[:prefix_length(len(s), spec.percent)])
            ends = np.cumsum([0, *map(len, prefix)])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["id", "n", "digest", "prefix"])
    return sketch


def _sets(spec: JoinSpec, shared):
    """ids, texts -> id, whole set as packed longs, of the ids that the bitmap holds."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in slices(batches):
            batch = batch.filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([token_set(t.as_py(), spec.words).tobytes() for t in batch.column(1)],
                                           pa.binary())], ["id", "tokens"])
    return sets


def _repeated(shared):
    """Prefixes -> one row per token that the bitmap holds."""
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in slices(batches, 4096):
            prefix = batch.column(2)
            token = prefix.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), np.diff(prefix.offsets.to_numpy()))
            keep = in_bitmap(bits, token)
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(token[keep])],
                                             ["rep", "n", "token"])
    return repeated


def _size_class(n: Column, percent: int) -> Column:
    """Sizes of linked sets are in the same or in neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("int")


def candidates(classes: DataFrame, spec: JoinSpec, scratch: list[DataFrame]) -> DataFrame:
    """Edges (a, b) of classes, whose components hold every linked pair.

    ``classes``: rep (a long), n, prefix.  A set of one token has no partner.  Tables
    that the edges are read from are added to ``scratch``."""
    multi = classes.where("n > 1")
    tokens = multi.select(F.explode("prefix").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    # only tokens that others have: what a set has alone counts, but can't be met
    bits = classes.sparkSession.sparkContext.broadcast(bitmap(shared, "token"))
    rows = multi.select("rep", "n", "prefix").mapInArrow(_repeated(bits), "rep long, n long, token long")
    met = materialize(rows.join(shared, "token").select("rep", "n", "token", "df"), "met")
    e = may_miss(F.col("n"), spec.percent)
    must = F.least(F.col("n"), 2 * e + 2) - e  # shared with a linked set, if this prefix ends first
    often = F.col("df") > spec.rare
    own = (met.groupBy("rep", "n").agg(F.count(F.when(often, 1)).cast("int").alias("n_often"),
                                       F.array_sort(F.collect_list(F.when(often, F.struct("df", "token")))).alias("t"))
              .withColumn("lacks", must - F.col("n_often")))
    own = materialize(own, "prefixes")
    scratch += [shared, met, own]
    # rare tokens: pairs within groups of at most ``rare`` sets
    few = met.where(~often).join(own.select("rep", "lacks"), "rep")
    few = few.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "lacks"))).alias("g"))
    both = few.select(F.inline(F.flatten(F.transform("g", lambda x, i: F.transform(
        F.slice("g", i + 2, F.size("g")), lambda y: F.struct(
            x["rep"].alias("a"), y["rep"].alias("b"), F.least(x["lacks"], y["lacks"]).alias("lacks"),
            (100 * F.least(x["n"], y["n"]) >= spec.percent * F.greatest(x["n"], y["n"])).alias("near")))))))
    by_rare = (both.where("near").groupBy("a", "b").agg(F.count("*").alias("both"), F.min("lacks").alias("lacks"))
                   .where("both >= lacks").select("a", "b"))
    # frequent tokens: the rarest, until they outweigh what may be missed
    own = (own.where("lacks <= 0").withColumn("need", F.lit(1) - F.col("lacks"))
              .withColumn("single", F.filter(F.slice("t", 1, F.col("need")), lambda x: x["df"] <= spec.frequent))
              .withColumn("paired", F.when(F.size("single") < F.col("need"),
                                           F.slice(F.filter("t", lambda x: x["df"] > spec.frequent), 1,
                                                   F.col("need") - F.size("single") + 1)))
              .withColumn("size", _size_class(F.col("n"), spec.percent)))
    own = materialize(own.select("rep", "size", F.transform("single", lambda x: x["token"]).alias("single"),
                                 F.array_sort(F.transform("paired", lambda x: x["token"])).alias("paired")), "picked")
    scratch.append(own)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    sized = met.where(often).withColumn("size", _size_class(F.col("n"), spec.percent))
    picked = own.select("rep", "size", F.explode("single").alias("token")).select(
        "rep", "token", "size", near.alias("d")).select("rep", "token", (F.col("size") + F.col("d")).alias("size"))
    lead = picked.groupBy("token", "size").agg(F.min("rep").alias("a"))
    by_one = (sized.join(lead, ["token", "size"]).select("a", F.col("rep").alias("b"))
                   .union(picked.join(lead, ["token", "size"]).select("a", F.col("rep").alias("b"))))
    # pairs of the most frequent, among sets of a size that a picking set can be linked with
    wide = own.where("paired is not null").select("rep", "paired", "size", near.alias("d")).select(
        "rep", "paired", (F.col("size") + F.col("d")).alias("size"))
    pairs = wide.select("rep", "size", _pairs("paired"))
    lead2 = pairs.groupBy("p", "q", "size").agg(F.min("rep").alias("a"))
    asked = wide.select("size", F.explode("paired").alias("token")).distinct()
    have = (sized.join(asked, ["token", "size"]).groupBy("rep", "size")
                 .agg(F.array_sort(F.collect_list("token")).alias("have")))
    by_two = (have.select("rep", "size", _pairs("have")).join(lead2, ["p", "q", "size"])
                  .select("a", F.col("rep").alias("b"))
                  .union(pairs.join(lead2, ["p", "q", "size"]).select("a", F.col("rep").alias("b"))))
    return by_rare.union(by_one).union(by_two).where("a <> b").distinct()


def _pairs(tokens: str) -> Column:
    """Rows p < q of a sorted array."""
    t = F.col(tokens)
    return F.inline(F.flatten(F.transform(t, lambda p, i: F.transform(
        F.slice(t, i + 2, F.size(t)), lambda q: F.struct(p.alias("p"), q.alias("q"))))))


#: Times that the sets of all clusters are sent to block pairs in a pass, at most.
SENT = 2
#: Sets of a block pair up to which a token is counted pair by pair; beyond, by a matrix product.
SPARSE = 48


def intersections(tok: np.ndarray, row: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Tokens that each of ``n_a`` sets shares with each of ``n_b``.

    ``tok``, ``row``: one entry per token of a set; rows from ``n_a`` on are the second
    block's."""
    order = np.argsort(tok, kind="stable")
    tok, row = tok[order], row[order]
    first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
    df = np.diff(np.r_[first, len(tok)])
    out = np.zeros(n_a * n_b, np.int64)
    for d in np.unique(df):
        if not 2 <= d <= SPARSE:
            continue
        at = first[df == d]
        step = max(1, 4_000_000 // int(d * d))
        for k in range(0, len(at), step):
            r = row[at[k:k + step, None] + np.arange(d)]
            p, q = np.broadcast_arrays(r[:, :, None], r[:, None, :])
            cross = (p < n_a) & (q >= n_a)
            code, n = np.unique(p[cross] * n_b + (q[cross] - n_a), return_counts=True)
            out[code] += n
    out = out.reshape(n_a, n_b)
    hot = first[df > SPARSE]
    width = max(1, 8_000_000 // max(1, n_a + n_b))
    sizes = df[df > SPARSE]
    for k in range(0, len(hot), width):
        m = np.zeros((n_a + n_b, len(hot[k:k + width])), np.float32)
        for c, (f, d) in enumerate(zip(hot[k:k + width], sizes[k:k + width])):
            m[row[f:f + d], c] = 1
        out += (m[:n_a] @ m[n_a:].T).astype(np.int64)  # exact: counts stay far under 2 ** 24
    return out


def _verify(spec: JoinSpec):
    """One pair of blocks of a cluster: forest edges and link counts of its sets."""
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values(["block", "rep"]).drop_duplicates("rep")
        one, two = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        both = pd.concat([one, two])
        sets = [np.frombuffer(x, np.int64) for x in both["tokens"]]
        n = np.array([len(x) for x in sets])
        tok = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        inter = intersections(tok, np.repeat(np.arange(len(sets)), n), len(one), len(two))
        n_a, n_b = n[:len(one)], n[len(one):]
        linked = 100 * inter >= spec.percent * (n_a[:, None] + n_b[None, :] - inter)
        if i == j:
            np.fill_diagonal(linked, False)
        rep_a, rep_b = one["rep"].to_numpy(), two["rep"].to_numpy()
        links = [linked @ two["copies"].to_numpy()] + ([] if i == j else [linked.T @ one["copies"].to_numpy()])
        # a forest: labels go to the least of a set's links until they stay
        label = np.arange(len(both)) if i != j else np.arange(len(one))
        a, b = np.nonzero(linked)
        b = b + (len(one) if i != j else 0)
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = low[low]
            if (low == label).all():
                break
            label = low
        rep = rep_a if i == j else np.concatenate([rep_a, rep_b])
        return pd.DataFrame({"a": rep[label], "b": rep, "links": np.concatenate(links)})
    return verify


def _dealt(members: DataFrame, spec: JoinSpec) -> tuple[DataFrame, int]:
    """A row for each member (cluster, rep, copies, n) and size class that it is held against, its own (``own``) or one
    beside it: the member's block, and the class's blocks from ``other`` on, ``others`` of them; and the passes.

    A block is its size class (of a cluster of one block: 0) and the part of the class that a hash says."""
    blocks = F.ceil(F.greatest(F.count("*") / spec.block, F.sum("n") / spec.tokens)).cast("int")
    several = members.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1").select("cluster", F.lit(True).alias("several"))
    members = members.join(several, "cluster", "left").withColumn(
        "size", F.when(F.col("several"), _size_class(F.col("n"), spec.percent)).otherwise(0).cast("long"))
    classes = materialize(members.groupBy("cluster", "size").agg(blocks.alias("others")), "sizes")
    first = lambda size: F.shiftleft(size, 32)
    parts = classes.select("cluster", "size", F.col("others").alias("parts"))
    members = (members.join(parts, ["cluster", "size"])
                      .withColumn("block", first(F.col("size")) + F.pmod(F.xxhash64("rep"), F.col("parts")))
                      .withColumn("beside", F.explode(F.when(F.col("several"), F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0)))))
                      .withColumn("size", F.col("size") + F.col("beside")))
    dealt = materialize(members.join(classes, ["cluster", "size"]).select(
        "cluster", "rep", "copies", "n", "block", first(F.col("size")).alias("other"), "others", (F.col("beside") == 0).alias("own")), "members")
    discard(classes)
    sent, sets = dealt.agg(F.sum(F.col("n") * F.col("others")), F.sum(F.when(F.col("own"), F.col("n")))).first()
    return dealt, max(1, math.ceil((sent or 0) / (SENT * (sets or 1))))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 spec: JoinSpec = JoinSpec()) -> DataFrame:
    """Per input row: id, n_shingles, component_id (least id reachable by links),
    n_links (documents linked with it, copies included)."""
    spark = docs.sparkSession
    workers_import(spark)
    two = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    sketch = materialize(two.mapInArrow(_sketch(spec), "id long, n long, digest binary, prefix array<long>"), "sketch")
    prefixes = materialize(
        sketch.where("n > 0 and id is not null").groupBy("digest")
              .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"),
                   F.first("prefix").alias("prefix")), "classes")
    every = materialize(sketch.drop("prefix"), "sets")
    discard(sketch)
    scratch = [prefixes]
    cluster = components(candidates(prefixes, spec, scratch))
    classes = materialize(prefixes.drop("prefix"), "classes")
    for table in scratch:
        discard(table)
    members = cluster.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).union(
        cluster.select(F.col("root").alias("rep"), F.col("root").alias("cluster"))).distinct()
    members = members.join(classes.select("rep", "copies", "n"), "rep")
    members, passes = _dealt(members, spec)
    # texts of members only: a filter of bounded size, then the exact join on small rows
    has = spark.sparkContext.broadcast(bitmap(members.where("own"), "rep"))
    sets = two.where("id is not null").mapInArrow(_sets(spec, has), "id long, tokens binary")
    if passes > 1:
        sets = materialize(sets, "tokens", {"parquet.enable.dictionary": "false"})
    # both sides grow with the copies: by shuffle at every size
    met = members.join(sets.hint("merge"), members["rep"] == sets["id"])
    found = []
    for k in range(passes):
        pair = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.struct(
            F.least("block", F.col("other") + x).alias("i"), F.greatest("block", F.col("other") + x).alias("j")))
        now = F.filter(pair, lambda x: F.pmod(F.xxhash64("cluster", x["i"], x["j"]), F.lit(passes)) == k)
        sent = met.select("cluster", F.explode(now).alias("x"), "rep", "block", "copies", "tokens").select("cluster", "x.*", "rep", "block", "copies", "tokens")
        found.append(materialize(sent.groupBy("cluster", "i", "j").applyInPandas(_verify(spec), "a long, b long, links long"), "found"))
    has.destroy()
    if passes > 1:
        discard(sets)
    discard(members)
    found = functools.reduce(DataFrame.union, found)
    root = components(found.select("a", "b"))
    links = found.groupBy(F.col("b").alias("rep")).agg(F.sum("links").alias("links"))
    known = (classes.select("digest", "rep", "copies").join(root, classes["rep"] == root["node"], "left")
                    .join(links, "rep", "left")
                    .select("digest", F.coalesce("root", "rep").alias("component_id"),
                            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = every.select("id", "n", "digest").join(known, "digest", "left")
    has_id = F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.when(has_id, F.coalesce("component_id", "id")).alias("component_id"),
                      F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                spec: JoinSpec = JoinSpec()) -> DataFrame:
    """One row of every component, with its columns: that of least id; a row without an id only where no
    row of its component has one (it goes by a number of 2 ** 62 or more made of its text, above all ids).
    Of repeated rows (one id, or none, and one text) the first by the hash of all columns stays.  Rows
    without a word are linked with nothing and all stay; so do rows of one id with different texts."""
    key, digest = fresh(docs, "key"), fresh(docs, "digest")
    made = F.lit(1 << 62) + F.xxhash64(col(text_col)).bitwiseAND(F.lit((1 << 62) - 1))
    d = docs.withColumn(key, F.coalesce(col(id_col).cast("long"), made))
    j = jaccard_join(d, key, text_col, spec)
    gone = j.where(col(key) != col("component_id")).select(col(key)).distinct()
    left = without(d, materialize(gone, "gone"), key)
    # repeated rows: found by small rows; only those that a filter of fixed size lets pass meet in a window
    keyed = left.withColumn(digest, F.when(col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(col(text_col))))
    again = materialize(keyed.where(col(digest).isNotNull()).groupBy(col(key), col(digest)).agg(F.count("*").alias("n")).where("n > 1")
                             .select(col(key), col(digest)), "repeated")
    s, rank = fresh(keyed, "slot"), fresh(keyed, "rank")
    taken = slots_of(again, key, digest).withColumnRenamed("slot", s)
    keyed = keyed.withColumn(s, F.when(col(digest).isNotNull(), slot(col(key), col(digest))))
    some = keyed.join(taken, s, "left_semi")
    first = Window.partitionBy(col(key), col(digest), col(text_col)).orderBy(F.xxhash64(*[col(c) for c in docs.columns]))
    one = some.withColumn(rank, F.row_number().over(first)).where(col(rank) == 1)
    names = [col(c) for c in docs.columns]
    return keyed.join(taken, s, "left_anti").select(*names).unionByName(one.select(*names))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
