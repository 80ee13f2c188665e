"""Byte-pair encoding and decoding with word ends, by contiguous rank arrays.

A text is split at its special tokens, normalised (NFC, lower case) and cut into
words; a word's bytes become parts, held in two short arrays: the ids and
the rank of each adjacent pair.  The least rank is found by scanning, its
boundary deleted, and the two neighbouring ranks refreshed, until no pair
has a rank.  Words over ``SHORT`` bytes, where scanning would be quadratic,
use the same merges from a heap.

Defined results: a null text encodes as an empty one (no ids) and null ids decode
to an empty text; empty tables stay empty; repeated rows are each encoded; texts
of any length are encoded whole; all other columns pass through untouched.
Characters that Unicode added in its latest versions may be classed otherwise
than by other libraries, as each library has its own tables.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import col, fresh, read_table, slices, workers_import

#: Bytes up to which a word's ranks are scanned.
SHORT = 96
#: Pieces whose ids a worker remembers; twice as many at most are held.
REMEMBERED = 50_000
END = "</w>"

# The word pattern of this vocabulary, and what it calls white space.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")
#: Python's split() also cuts at these, which the pattern takes for signs.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary:
    itself where printable, else the next code point from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_NONE = 1 << 62


class Vocabulary:
    """What a tokenizer file says: parts, merges by rank, special tokens."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, letters = spec["model"], byte_letters()
        ids = model["vocab"]
        self.tokens = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.inner = [0] * 256
        self.last = [0] * 256
        for letter, byte in letters.items():
            self.inner[byte], self.last[byte] = ids[letter], ids[letter + END]
        # two adjacent ids -> their rank and, below it, the id that they make
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(ids[a] << 32 | ids[b], rank << 32 | ids[a + b])
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._scanned(parts) if len(parts) <= SHORT else self._heaped(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)  # equal ranks are the same pair: the leftmost goes first
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], _NONE)
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = []

        def push(i: int) -> None:
            if 0 <= i and after[i] < n and (m := self.merges.get(parts[i] << 32 | parts[after[i]])):
                heapq.heappush(heap, (m >> 32, i, m & 0xFFFFFFFF, parts[i], parts[after[i]]))

        for i in range(n):
            push(i)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            if not live[i] or after[i] >= n or parts[i] != left or parts[after[i]] != right:
                continue
            gone = after[i]
            parts[i], live[gone], after[i] = made, False, after[gone]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            push(before[i])
        return [p for p, on in zip(parts, live) if on]


class _Known(dict):
    """Key -> packed ids, found on first use; the latest keys are remembered."""

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(key)
        if ids is None:
            ids = self.find(key)
        self[key] = ids
        return ids


class Encoder:
    """Text -> packed ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = _Known(self._word)
        self.pieces = _Known(self._piece)

    def _word(self, word: str) -> bytes:
        ids = self.vocabulary.word(word.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # one word: remembered as a piece, not twice
            return self._word(piece)
        return b"".join(map(self.words.__getitem__, WORD.findall(piece)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        special = self.vocabulary.special
        parts = self.vocabulary.split.split(text) if any(t in text for t in special) else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(struct.pack("<I", special[part]))
                continue
            part = normal(part)
            if _SEPARATORS.search(part):
                out.append(self._piece(part))
            else:  # no word crosses white space
                out.extend(map(self.pieces.__getitem__, part.split()))
        return b"".join(out)


def normal(text: str) -> str:
    """NFC and lower case, letter by letter (so a final sigma is as any other)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def decode_ids(ids: bytes | None, vocabulary: Vocabulary) -> str:
    """The tokens of the ids, one space between: what a vocabulary without a decoder says."""
    return " ".join(map(vocabulary.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@functools.lru_cache(2)
def load(data: bytes) -> Encoder:
    """Vocabulary and remembered words, kept by each worker."""
    return Encoder(Vocabulary(data))


def _file(docs: DataFrame, path: str):
    """The file's bytes (a vocabulary: a few MB whatever the corpus) for the workers."""
    spark = docs.sparkSession
    workers_import(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(docs: DataFrame, path: str):
    """Column function: text -> ids, packed as little-endian unsigned 32-bit integers."""
    shared = _file(docs, path)

    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoded = load(shared.value)
        for batch in slices(texts):
            yield pa.array([encoded(t.as_py()) for t in batch], pa.binary())

    return F.arrow_udf(encode, "binary")


def decoder(docs: DataFrame, path: str):
    """Column function: packed ids -> text."""
    shared = _file(docs, path)

    def decode(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(shared.value).vocabulary
        for batch in slices(packed):
            yield pa.array([decode_ids(x.as_py(), vocabulary) for x in batch], pa.string())

    return F.arrow_udf(decode, "string")


def encode_decode(docs: DataFrame, path: str, text_col: str = "text",
                  ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the packed ids of the text and the text decoded from those ids, in
    one pass of one worker.  Columns already so named are replaced."""
    shared = _file(docs, path)

    def code(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoded = load(shared.value)
        for batch in slices(texts):
            ids = [encoded(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()),
                 pa.array([decode_ids(x, encoded.vocabulary) for x in ids], pa.string())], ["ids", "decoded"])

    c = fresh(docs, "coded")
    return (docs.withColumn(c, F.arrow_udf(code, "ids binary, decoded string")(col(text_col)))
                .withColumn(ids_col, col(c)["ids"]).withColumn(decoded_col, col(c)["decoded"]).drop(c))


def unpack(ids: Column) -> Column:
    """Packed ids as array<long>."""
    def take(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, "<u4").astype(np.int64)
                         for x in batch.to_pylist()], pa.list_(pa.int64()))
    return F.arrow_udf(take, "array<long>")(ids)


def digests(coded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    return coded.select("doc_id", (F.octet_length(col(ids_col)) / 4).cast("long").alias("n_tokens"),
                        F.sha2(col(ids_col), 256).alias("ids_sha256"),
                        F.sha2(col(decoded_col), 256).alias("decoded_sha256"))


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, vocabulary_path()))
