"""Context-tree weighting over bytes to depth ``DEPTH``: every seen context counts, and
texts are scored by the model without gathering it.

A *gram* is a byte after its ``DEPTH`` preceding bytes, as a number with the last of them
first, so that the contexts of every depth are prefixes and lie together in order.

1. *Chunks*: texts are joined to chunks of about ``CHUNK`` bytes, packed and stored once.
2. *Grams*: each chunk sends its distinct grams, and how often training texts have them, in
   lists by *bucket*: a bucket has all grams whose last ``TOP`` bytes of context fall into it,
   so it holds whole subtrees.  Buckets grow in number with the corpus.
3. *Weights*: a bucket adds up its lists and weighs the nodes of its subtrees from the deepest
   up, about ``PIECE`` grams at a time; those at depth ``TOP`` go on, by last byte, to depths 2 and 1; the root's 255 are added
   at the driver.  Depths 1 and 2 (65,536 contexts of 255 nodes at most, of which those seen)
   are broadcast.
4. *Scores*: each bucket, from the root down, finds the probabilities of its grams and answers
   every list; a chunk's answers meet its texts.

Texts of any length are read whole; a chunk's texts are handled by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import col, slices, workers_import
from strata.session import defaults, discard, materialize

#: Bytes of context: a gram is one byte more, and 56 bits.
DEPTH = 6
#: Bytes of the context that tell the bucket.
TOP = 3
#: Bytes of texts in a chunk, that are sorted together, and for each bucket.
CHUNK, SLAB, BUCKET = 1 << 23, 1 << 19, 1 << 23
#: Grams that are counted or weighed together.
PIECE = 1 << 16
#: Rows of several MB, packed already: they are sent and written one or few at a time.
_SENT = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}
_WRITTEN = {"compression": "none", "parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1"}
_TABLE = 1 << 14
LN2 = np.log(2)


def packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack_numbers(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte of all (these pack well in order)."""
    return packed(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack_numbers(data: bytes, size: int, width: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = np.frombuffer(unpacked(data, size * width), np.uint8).reshape(width, size).T
    return out.reshape(-1).view("<i8")


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """Of every byte and end mark of the texts, in order."""
    edge = b"\xff" * depth
    b = np.frombuffer(b"".join(x for t in texts for x in (edge, t, b"\xff")), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + depth + 1
    inside = np.ones(len(b), bool)
    inside[((np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)).ravel()] = False
    out = b[depth:].astype(np.int64)
    for j in range(depth):
        out |= b[depth - 1 - j:len(b) - 1 - j].astype(np.int64) << (8 * (depth - j))
    return out[inside[depth:]]


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[start], np.add.reduceat(n, start) if len(start) else n


def slabs(texts: list[bytes], most: int, count: int) -> Iterator[tuple[int, int]]:
    """Ranges of up to ``count`` texts of about ``most`` bytes (a longer text is one)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > most or i - at == count):
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def distinct(texts: list[bytes], trained: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often the training texts have each."""
    x, at = np.empty(sum(map(len, texts)) + len(texts), np.int64), 0
    for a, z in slabs(texts, SLAB, len(texts)):
        g = grams(texts[a:z], depth)
        g <<= 1
        g |= np.repeat(trained[a:z], [len(t) + 1 for t in texts[a:z]])
        x[at:at + len(g)] = g
        at += len(g)
    x.sort()  # in place, and counted from where runs begin, over what was read: little is held beside it
    n, done = np.empty(len(x), np.uint32), 0
    first = lambda y: np.flatnonzero(np.r_[True, y[1:] != y[:-1]][:len(y)])
    for a, z in pieces(x, 1):
        start = first(x[a:z])
        k = x[a:z][start]
        times = np.diff(np.r_[start, z - a]) * (k & 1)
        k >>= 1
        start = first(k)
        x[done:done + len(start)], n[done:done + len(start)] = k[start], np.add.reduceat(times, start)
        done += len(start)
    return x[:done], n[:done]


def pieces(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` of the sorted keys; those that are equal but for their low bits stay together."""
    a = 0
    while a < len(keys):
        z = len(keys)
        if a + PIECE < z:
            z = int(np.searchsorted(keys, keys[a + PIECE] >> shift << shift))
            if z <= a:
                z = int(np.searchsorted(keys, (keys[a] >> shift) + 1 << shift))
        yield a, z
        a = z


def subtree_bits(depth: int) -> int:
    """Low bits of a gram that don't tell its subtree at depth ``TOP``."""
    return 8 * (depth + 1 - TOP)


def by_bucket(keys: np.ndarray, depth: int, buckets: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Buckets that have any of the sorted keys, and the ranges of the keys that each has, in order."""
    top = keys >> subtree_bits(depth)
    start = np.flatnonzero(np.r_[True, top[1:] != top[:-1]][:len(top)])
    bucket = top[start] * 0x9E3779B1 % (1 << 32) * buckets >> 32
    order, ends = np.argsort(bucket, kind="stable"), np.r_[start[1:], len(keys)]
    bucket, ranges = bucket[order], list(zip(start[order].tolist(), ends[order].tolist()))
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)]).tolist()
    for a, z in zip(at, [*at[1:], len(ranges)]):
        yield int(bucket[a]), ranges[a:z]


# ---- one bucket's subtrees

def _log_gammas() -> tuple[np.ndarray, np.ndarray]:
    from strata.llm.context_tree import log_gamma
    n = np.arange(_TABLE, dtype=float)
    return log_gamma(n + .5), log_gamma(n + 1)


_gammas: list[np.ndarray] = []


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """As ``context_tree.log_kt``, small counts looked up."""
    from strata.llm.context_tree import log_kt as exact
    if not _gammas:
        _gammas.extend(_log_gammas())
    half, whole = _gammas
    n = n0 + n1
    few = n < _TABLE
    a, b = np.where(few, n0, 0), np.where(few, n1, 0)
    out = half[a] + half[b] - whole[a + b] - np.log(np.pi)
    if not few.all():
        out[~few] = exact(n0[~few], n1[~few])
    return np.where(n > 0, out, 0.0)


class Nodes:
    """The decision nodes of one depth and one bit of the byte: those of grams with equal context
    and equal higher bits."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int):
        part = keys >> (8 - bit)
        new = np.r_[True, part[1:] != part[:-1]][:len(part)]
        self.start = np.flatnonzero(new)
        self.of = np.cumsum(new, dtype=np.int32) - 1  # of each gram: its node
        part = part[self.start]
        # context and place in the binary tree of decisions
        self.name = (part >> bit) << 8 | 1 << bit | part & (1 << bit) - 1
        empty = not len(keys)
        self.ones = n if empty else np.add.reduceat(n * (keys >> (7 - bit) & 1), self.start)
        self.zeros = n if empty else np.add.reduceat(n, self.start) - self.ones
        self.up = None  # of each node: that of the next shorter context


class Subtrees:
    """Grams of one bucket and their nodes at depths ``TOP`` to ``depth``, weighed."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.keys, self.depth, self.nodes = keys, depth, {}
        below = None
        for d in range(depth, TOP - 1, -1):
            here = [Nodes(keys, n, bit) for bit in range(8)]
            if below is not None:
                for x, y in zip(below, here):
                    x.up = y.of[up[x.start]]
            self.nodes[d] = below = here
            if d > TOP:
                keys, up = np.unique(keys >> 16 << 8 | keys & 255, return_inverse=True)
                n = np.bincount(up, n, len(keys)).astype(np.int64)
        for d in range(depth, TOP - 1, -1):
            for bit, x in enumerate(self.nodes[d]):
                x.weighted = kt = log_kt(x.zeros, x.ones)
                if d < depth:
                    y = self.nodes[d + 1][bit]
                    x.weighted = np.logaddexp(kt, np.bincount(y.up, y.weighted, len(kt))) - LN2
                x.stop = np.exp(kt - LN2 - x.weighted)

    def top(self) -> np.ndarray:
        """name, zeros, ones, weighted (as the bits of a float) of the seen nodes at depth ``TOP``."""
        out = []
        for x in self.nodes[TOP]:
            on = x.zeros + x.ones > 0
            out.append(np.stack([x.name[on], x.zeros[on], x.ones[on], x.weighted[on].view(np.int64)]))
        return np.concatenate(out, axis=1)

    def logs(self, above: Upper) -> np.ndarray:
        """log10 probability of each gram's byte after its context."""
        p = np.ones(len(self.keys))
        for bit in range(8):
            x = self.nodes[TOP][bit]
            state = above.at(x.name >> 16 << 8 | x.name & 255)
            for d in range(TOP, self.depth + 1):
                x = self.nodes[d][bit]
                if d > TOP:
                    state = tuple(s[x.up] for s in state)
                state = step(state, x.zeros, x.ones, x.stop)
            one = state[2][x.of]
            p *= np.where(self.keys >> (7 - bit) & 1, one, 1 - one)
        return np.log10(p)


def step(state, zeros, ones, stop):
    """From a context to one byte more: (what the shorter contexts that stop give to the probability
    of a one, the share that goes on, the probability if nothing longer is seen); nodes that
    training never saw keep those of the last seen one."""
    so_far, rest, end = state
    seen = zeros + ones > 0
    one = (ones + .5) / (zeros + ones + 1)
    return (np.where(seen, so_far + rest * stop * one, so_far), np.where(seen, rest * (1 - stop), rest),
            np.where(seen, so_far + rest * one, end))


class Upper:
    """States of the nodes at depths 0 to 2, from their counts."""

    def __init__(self, nodes: pd.DataFrame):
        one, two = (nodes[nodes["depth"] == d].sort_values("name") for d in (1, 2))
        zeros, ones, below = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256)
        for total, c in ((zeros, "zeros"), (ones, "ones"), (below, "weighted")):
            np.add.at(total, one["name"].to_numpy(np.int64) & 255, one[c].to_numpy())
        kt = log_kt(zeros, ones)
        stop = np.exp(kt - np.logaddexp(kt, below))
        root = step((np.zeros(256), np.ones(256), np.full(256, .5)), zeros, ones, stop)
        self.first = [np.tile(s, 256) for s in root]  # by last byte << 8 | node
        name = one["name"].to_numpy(np.int64)
        for s, v in zip(self.first, step(tuple(s[name] for s in self.first), *(one[c].to_numpy() for c in ("zeros", "ones", "stop")))):
            s[name] = v
        self.names = two["name"].to_numpy(np.int64)
        first = (self.names >> 16) << 8 | self.names & 255
        self.second = step(tuple(s[first] for s in self.first), *(two[c].to_numpy() for c in ("zeros", "ones", "stop")))

    def at(self, names: np.ndarray):
        """States of contexts of two bytes; of their last byte if training never saw both."""
        out = [s[(names >> 16) << 8 | names & 255] for s in self.first]
        if len(self.names):
            i = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            seen = self.names[i] == names
            out = [np.where(seen, s[i], o) for s, o in zip(self.second, out)]
        return tuple(out)


def _upper(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes at depths 2 and 1 of one last byte, from those at depth ``TOP``."""
    out = []
    name, zeros, ones, below = (pdf[c].to_numpy() for c in ("name", "zeros", "ones", "weighted"))
    for d in range(TOP - 1, 0, -1):
        name, at = np.unique(name >> 16 << 8 | name & 255, return_inverse=True)
        zeros, ones = (np.bincount(at, x).astype(np.int64) for x in (zeros, ones))
        kt, below = log_kt(zeros, ones), np.bincount(at, below)
        weighted = np.logaddexp(kt, below) - LN2
        out.append(pd.DataFrame({"depth": d, "name": name, "zeros": zeros, "ones": ones, "weighted": weighted,
                                 "stop": np.exp(kt - LN2 - weighted)}))
        below = weighted
    return pd.concat(out)


# ---- tasks

def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids, training or not, texts -> texts of a chunk, in lower case."""
    from strata.llm.context_tree import lowered
    ids, trained, texts, size = [], [], [], 0

    def sent() -> pa.RecordBatch:
        one = [0, len(texts)]
        ids_ = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(one, ids_), pa.ListArray.from_arrays(one, pa.array(trained, pa.bool_())),
             pa.ListArray.from_arrays(one, pa.array([len(t) for t in texts], pa.int32())),
             pa.array([packed(b"".join(texts))], pa.binary()), pa.array([size], pa.int64())],
            ["ids", "trained", "sizes", "texts", "bytes"])

    for batch in slices(batches, 64):
        if not len(batch):
            continue
        new = [lowered(t.as_py()) for t in batch.column(2)]
        if texts and size + sum(map(len, new)) > CHUNK:
            yield sent()
            ids, trained, texts, size = [], [], [], 0
        ids.append(batch.column(0))
        trained += batch.column(1).to_pylist()
        texts += new
        size += sum(map(len, new))
    if texts:
        yield sent()


def _texts(sizes: np.ndarray, data: bytes) -> list[bytes]:
    data, ends = unpacked(data, int(sizes.sum())), np.cumsum(sizes).tolist()
    return [data[a:z] for a, z in zip([0, *ends], ends)]


def sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``SLAB`` bytes."""
    some, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)

    for row in rows:
        some.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SLAB:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


_LISTS = "bucket long, chunk long, size int, grams binary, n binary"


def _lists(depth: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("size", pa.int32()), ("grams", pa.binary()), ("n", pa.binary())])

    def of_chunk(row: dict) -> Iterator[tuple]:
        texts = _texts(np.array(row["sizes"], np.int64), row["texts"])
        keys, n = distinct(texts, np.array(row["trained"], np.int64), depth)
        del texts
        for bucket, ranges in by_bucket(keys, depth, buckets):
            k, m = (np.concatenate([x[a:z] for a, z in ranges]) for x in (keys, n))
            yield bucket, row["chunk"], len(k), pack_numbers(k, depth + 1), pack_numbers(m, 4)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in slices(batches, 1):
            for row in chunk.to_pylist():
                yield from sent(of_chunk(row), schema)
    return lists


def merged(lists: list[tuple[np.ndarray, np.ndarray]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams of sorted lists and their sums, in order, about ``PIECE`` of all (whole subtrees) at a time."""
    some, shift = np.sort(np.concatenate([k[::64] for k, _ in lists])), subtree_bits(depth)
    cuts = np.unique(some[max(1, PIECE // 64)::max(1, PIECE // 64)] >> shift << shift)
    at = [[0, *np.searchsorted(k, cuts).tolist(), len(k)] for k, _ in lists]
    for i in range(len(cuts) + 1):
        keys = np.concatenate([k[x[i]:x[i + 1]] for (k, _), x in zip(lists, at)])
        if len(keys):
            yield added(keys, np.concatenate([n[x[i]:x[i + 1]] for (_, n), x in zip(lists, at)]).astype(np.int64))


_BUCKET = ("bucket long, chunks array<long>, sizes array<int>, lists array<binary>, size int, grams binary, n binary, nodes array<int>, top array<binary>")


def _bucket(depth: int):
    """The lists of a bucket -> themselves, its grams with their sums, its nodes at depth ``TOP``."""
    def bucket(table: pa.Table) -> pa.Table:
        sizes, keys, n, nodes, tops = table["size"].to_pylist(), [], [], [], []
        lists = [(unpack_numbers(x.as_py(), k, depth + 1), unpack_numbers(y.as_py(), k, 4).astype(np.uint32))
                 for x, y, k in zip(table["grams"], table["n"], sizes)]
        for k, m in merged(lists, depth):
            keys.append(k)
            n.append(m)
            top = Subtrees(k, m, depth).top()
            nodes.append(top.shape[1])
            tops.append(packed(top.tobytes()))
        del lists
        keys, n = np.concatenate(keys), np.concatenate(n)
        return pa.table({"bucket": table["bucket"].slice(0, 1), "chunks": pa.array([table["chunk"].to_pylist()], pa.list_(pa.int64())),
                         "sizes": pa.array([sizes], pa.list_(pa.int32())), "lists": pa.array([table["grams"].to_pylist()], pa.list_(pa.binary())),
                         "size": pa.array([len(keys)], pa.int32()), "grams": pa.array([pack_numbers(keys, depth + 1)], pa.binary()),
                         "n": pa.array([pack_numbers(n, 8)], pa.binary()), "nodes": pa.array([nodes], pa.list_(pa.int32())),
                         "top": pa.array([tops], pa.list_(pa.binary()))})
    return bucket


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, x in zip(*(c.flatten() for c in batch.columns)):
            name, zeros, ones, weighted = np.frombuffer(unpacked(x.as_py(), 32 * k.as_py()), np.int64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((name >> 24).astype(np.int32)), *map(pa.array, (name, zeros, ones, weighted.view(float)))],
                ["last", "name", "zeros", "ones", "weighted"])


def _answers(shared, depth: int):
    """Each list's grams with their log10 probabilities."""
    schema = pa.schema([("chunk", pa.int64()), ("size", pa.int32()), ("grams", pa.binary()), ("logs", pa.binary())])

    def of_bucket(r: dict) -> Iterator[tuple]:
        keys, n = (unpack_numbers(r[c], r["size"], width) for c, width in (("grams", depth + 1), ("n", 8)))
        logs = np.empty(len(keys), "<f4")
        for a, z in pieces(keys, subtree_bits(depth)):
            logs[a:z] = Subtrees(keys[a:z], n[a:z], depth).logs(shared.value)
        for chunk, k, x in zip(r["chunks"], r["sizes"], r["lists"]):
            yield chunk, k, x, packed(logs[np.searchsorted(keys, unpack_numbers(x, k, depth + 1))].tobytes())

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            for r in row.to_pylist():
                yield from sent(of_bucket(r), schema)
    return answers


def chunk_scores(texts: list[bytes], keys: np.ndarray, logs: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each text and its end, from those of the distinct grams of all."""
    out = np.zeros(len(texts))
    for a, z in slabs(texts, SLAB, 256):
        # a gram and the text that it is in are one number
        text = np.repeat(np.arange(z - a, dtype=np.uint64), [len(t) + 1 for t in texts[a:z]])
        x = grams(texts[a:z], depth).view(np.uint64)
        x = np.sort(x << np.uint64(8) | text)
        found = (x >> np.uint64(8)).view(np.int64)
        start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        found = found[start]
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        if not np.array_equal(keys[at], found):
            raise ValueError("a gram has no answer")
        each = np.repeat(logs[at].astype(float), np.diff(np.r_[start, len(x)]))
        out[a:z] = np.bincount((x & np.uint64(255)).view(np.int64), each, z - a)
    return out


def _finished(depth: int, finish: Callable[[list[bytes], np.ndarray], pa.StructArray]):
    def finished(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = chunk.combine_chunks()
        ids = chunk["ids"].chunk(0).flatten()
        texts = _texts(chunk["sizes"].chunk(0).flatten().to_numpy(), chunk["texts"][0].as_py())
        sizes = answers["size"].to_pylist()
        keys = np.concatenate([unpack_numbers(x.as_py(), k, depth + 1) for x, k in zip(answers["grams"], sizes)])
        logs = np.concatenate([np.frombuffer(unpacked(x.as_py(), 4 * k), "<f4") for x, k in zip(answers["logs"], sizes)])
        order = np.argsort(keys)
        scores = chunk_scores(texts, keys[order], logs[order], depth)
        del keys, logs, order

        def rows(a: int, z: int) -> pa.RecordBatch:
            some = finish(texts[a:z], scores[a:z])
            return pa.RecordBatch.from_arrays([ids.slice(a, z - a), *some.flatten()], ["id", *(f.name for f in some.type)])
        return pa.Table.from_batches([rows(a, z) for a, z in slabs(texts, SLAB, 256)])
    return finished


def scored(docs: DataFrame, trained: Column, finish: Callable[[list[bytes], np.ndarray], pa.StructArray], fields: str,
           id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per input row: id, and ``fields`` as ``finish`` gives them for (texts as bytes, their log10
    probabilities); the rows where ``trained`` is true are learned from."""
    if not TOP <= depth <= 6:
        raise ValueError(f"contexts of {TOP} to 6 bytes")
    spark = docs.sparkSession
    workers_import(spark)
    source = docs.select(col(id_col).alias("id"), F.coalesce(trained, F.lit(False)).alias("trained"), col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    with defaults(spark, _SENT):
        chunks = materialize(source.mapInArrow(_chunks, f"ids array<{id_type}>, trained array<boolean>, sizes array<int>, texts binary, bytes long")
                             .select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks", _WRITTEN)
        buckets = int(chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // BUCKET + 1)
        lists = chunks.select("chunk", "trained", "sizes", "texts").mapInArrow(_lists(depth, buckets), _LISTS)
        packs = materialize(lists.groupBy("bucket").applyInArrow(_bucket(depth), _BUCKET), "buckets", _WRITTEN)
        top = packs.select("nodes", "top").mapInArrow(_tops, "last int, name long, zeros long, ones long, weighted double")
        upper = top.groupBy("last").applyInPandas(_upper, "depth int, name long, zeros long, ones long, weighted double, stop double")
        shared = spark.sparkContext.broadcast(Upper(upper.toPandas()))
        answers = packs.select("bucket", "chunks", "sizes", "lists", "size", "grams", "n").mapInArrow(
            _answers(shared, depth), "chunk long, size int, grams binary, logs binary")
        both = chunks.select("chunk", "ids", "sizes", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk"))
        done = materialize(both.applyInArrow(_finished(depth, finish), f"id {id_type}, {fields}")
                           .select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    discard(packs)
    discard(chunks)
    return done
