r"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ten consecutive words (shorter items are one
window).  A window is the set of its five-word shingles with their places, and
it occurs in a document where all of them do.

1. *Shingles*: the documents' shingles that some window has are looked up, first
   by a slot filter of fixed size, then by an exact join on the words.
2. *Rarity*: those shingles are counted over all documents.  A window with a
   shingle that no document has cannot occur.
3. *Prefix*: as all shingles of a window are necessary, its prefix is its rarest
   one; only documents with that shingle become candidates.
4. *Bounds*: the window must start at or after the first word and end by the last.
5. *Verification*: every shingle of the window stands at its place.

All steps are DataFrame operations.  Defined results: null texts and texts without
a word have no words and no hits; items without a word or an id have no windows;
empty tables give no hits; repeated rows are each reported, and repeated items
count once; rows of one id with different texts are judged apart; texts are read
whole.  Input columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import ascii_lower, col, fresh, read_table, slot, slots_of, without
from strata.session import materialize

WINDOW = 10
SHINGLE = 5
#: What stands between words, once A-Z is in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _shingles(w: Column, size: int) -> Column:
    """array<struct<pos, shingle>> of ``size`` words each; a shingle is its words, one space between."""
    last = F.size(w) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("pos"), F.array_join(F.slice(w, i + 1, size), " ").alias("shingle"))))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
            window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct window of an item: item, win (its words), len, size (of its shingles)."""
    w = items.where(col(id_col).isNotNull()).select(col(id_col).alias("item"), words(col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.lit(window), F.size("w")))
    starts = F.sequence(F.lit(1), F.size("w") - col("len") + 1)
    return (w.select("item", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i, col("len")))).alias("w"))
             .select("item", F.array_join("w", " ").alias("win"), "len",
                     F.least(F.lit(shingle), col("len")).alias("size"), "w").distinct())


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text: str = "text",
                window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Every occurrence of a window: doc, digest (of its text), start, len, item."""
    win = materialize(windows(items, item_col, item_text, window, shingle), "windows")
    parts = win.select("win", "size", "w").distinct().select(
        "win", "size", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("w") - col("size") + 1),
            lambda i: F.array_join(F.slice("w", i, col("size")), " "))).alias("k", "shingle"))
    parts = materialize(parts, "shingles")
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())  # at most SHINGLE values
    d = docs.select(col(id_col).alias("doc"), F.xxhash64(col(text_col)).alias("digest"),
                    words(col(text_col)).alias("w"))
    every = F.concat(*[F.coalesce(_shingles(col("w"), s), F.array().cast("array<struct<pos:int,shingle:string>>"))
                       for s in sizes or [shingle]])
    had = d.select("doc", "digest", F.size("w").alias("n"), F.inline(every))
    maybe = had.withColumn("slot", slot(col("shingle"))).join(slots_of(parts, "shingle"), "slot", "left_semi")
    known = parts.select("shingle").distinct()
    met = materialize(maybe.drop("slot").join(known, "shingle").distinct(), "met")
    rarity = met.groupBy("shingle").agg(F.count("*").alias("n_met"))
    # the rarest shingle of each window that can occur
    prefix = (parts.join(rarity, "shingle", "left").groupBy("win")
                   .agg(F.min(F.struct("n_met", "shingle", "k")).alias("p"),
                        F.count("n_met").alias("there"), F.count("*").alias("parts"))
                   .where(col("there") == col("parts"))
                   .select("win", "parts", "p.shingle", "p.k"))
    length = win.select("win", "len").distinct()
    found = (met.join(prefix.join(length, "win"), "shingle")
                .withColumn("start", col("pos") - col("k"))
                .where((col("start") >= 0) & (col("start") + col("len") <= col("n")))
                .select("doc", "digest", "start", "win", "len", "parts"))
    # all other shingles at their places
    asked = found.join(parts.select("win", "k", "shingle"), "win").withColumn("pos", col("start") + col("k"))
    at = met.select(col("doc").alias("d"), col("digest").alias("g"), col("pos").alias("p"), col("shingle").alias("s"))
    whole = (asked.join(at, asked["doc"].eqNullSafe(at["d"]) & (asked["digest"] == at["g"])
                        & (asked["pos"] == at["p"]) & (asked["shingle"] == at["s"]))
                  .groupBy("doc", "digest", "start", "win", "len", "parts").agg(F.count("*").alias("there"))
                  .where("there = parts"))
    return whole.join(win.select("win", "item"), "win").select("doc", "digest", "start", "len", "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per input row: id, n_words, n_hit (words inside an occurrence), items (sorted ids, as
    strings, of the items that occur)."""
    at = materialize(occurrences(docs, items, id_col, text_col, item_col, item_text, window, shingle), "occurrences")
    hit = (at.select("doc", "digest", F.explode(F.sequence("start", col("start") + col("len") - 1)).alias("pos"))
             .distinct().groupBy("doc", "digest").agg(F.count("*").alias("n_hit")))
    which = (at.select("doc", "digest", "item").distinct().groupBy("doc", "digest")
               .agg(F.array_sort(F.collect_list(col("item").cast("string"))).alias("items")))
    hit = hit.select(col("doc").alias("d"), col("digest").alias("g"), "n_hit")
    per = which.join(hit, which["doc"].eqNullSafe(hit["d"]) & (which["digest"] == hit["g"])).select(
        "d", "g", "n_hit", "items")
    d = docs.select(col(id_col).alias("doc"), F.xxhash64(col(text_col)).alias("digest"),
                    F.size(words(col(text_col))).cast("long").alias("n_words"))
    return d.join(per, d["doc"].eqNullSafe(per["d"]) & (d["digest"] == per["g"]), "left").select(
        col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any occurrence, with all the columns they came with.  A document goes by its
    id and the digest of its text, so that of two rows with one id only the contaminated one is dropped."""
    at = occurrences(docs, items, id_col, text_col, item_col, item_text)
    named = lambda i, digest: F.concat_ws(" ", i.cast("string"), F.lit("text"), digest.cast("string"))
    key = fresh(docs, "key")
    gone = materialize(at.select(named(col("doc"), col("digest")).alias(key)).distinct(), "contaminated")
    keyed = docs.withColumn(key, named(col(id_col), F.xxhash64(col(text_col))))
    return without(keyed, gone, key).drop(key)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (col("n_hit") > 0).alias("contaminated"))
