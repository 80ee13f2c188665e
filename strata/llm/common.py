"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACES = "\t\n\x0b\x0c\r "


#: Texts that go to a worker at once, where the session doesn't say: Spark's 10,000 are tens of MB, held
#: (in buffers of up to twice that) by the executor and again by the worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the Python path of the workers, so that
    functions named in a task are imported there (a cluster job ships the package
    with ``--py-files``; this only helps where the folder is visible).  Sets
    ``BATCHES`` for the session, too."""
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_part(c: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts`` (null ids: null)."""
    return F.crc32(c.cast("string").cast("binary")) % parts


#: Slots of the filters below: what is broadcast is this many integers at most.
SLOTS = 1 << 20


def slot(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def slots_of(df: DataFrame, *keys: str) -> DataFrame:
    """The slots that the keys of ``df`` fall in, to be broadcast whatever its size."""
    return F.broadcast(df.select(slot(*[col(k) for k in keys]).alias("slot")).distinct())


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` whose id is not in ``gone`` (one column of that name); null ids stay.

    Rows whose slot holds no id of ``gone`` pass without a shuffle; only the rest,
    in proportion to ``gone``, meet it in an exact join."""
    s = fresh(docs, "slot")
    taken = slots_of(gone, id_col).withColumnRenamed("slot", s)
    d = docs.withColumn(s, slot(col(id_col)))
    clear = d.join(taken, s, "left_anti")
    rest = d.join(taken, s, "left_semi").join(gone, id_col, "left_anti")
    names = [col(c) for c in docs.columns]
    return clear.select(*names).unionByName(rest.select(*names))


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow arrays or record batches in pieces of at most ``rows``, so that a worker holds
    the Python objects of a few hundred texts at a time, not of a whole Arrow batch."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


#: Bits of a bitmap of keys: 8 MB for up to 4 million keys, then in proportion, 64 MB whatever their number.
BITS, MOST_BITS = 1 << 26, 1 << 29
_ROW = 32768


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """One bit for each long in ``key``, at its value modulo the bits, of which there are 16 or more for
    each row of ``keys`` (see ``BITS``); set bits are combined per task, and at most MOST_BITS / 8 bytes reach the driver."""
    bits = min(max(BITS, 1 << (16 * keys.count() - 1).bit_length()), MOST_BITS)
    at = F.pmod(col(key), F.lit(bits)) + 1
    rows = (keys.select(F.bitmap_bucket_number(at).alias("r"), F.bitmap_bit_position(at).alias("p"))
                .groupBy("r").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r.r - 1) * _ROW // 8:r.r * _ROW // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
