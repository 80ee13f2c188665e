"""WARC archives: written as one gzip stream a file, then normalised to one member a record.

*Write*: each partition of pages becomes one archive, a single gzip stream of all
its records, by Spark's own text writer (a record per row, the blank lines that
end a record between rows), so any store and its commit protocol will do.
Of equal payloads only one is stored; the others are revisits of it.

*Normalise*: an archive's stream is inflated once, piece by piece; every record is
written as a gzip member of its own, and a sidecar index keeps where each
member starts and how long it is.  The members of an archive, in the order of
their offsets, are the normalised file.

*Read*: any record can be read by its place alone: archive, offset and length from the
index (``read_records``).  ``read_archives``, and so the query, reads every member
and needs no index.

Defined results: null html is an empty payload, a null url leaves its header out,
line breaks in a url are percent-encoded, and pages without an id are written and
read with none; payloads under ``min_bytes`` are never revisits; of equal payloads
the least page id is the response, and so is any repeated row of that id; null
ids refer to the least id that is not null and are responses where there is
none; an empty table gives empty archives.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import col, read_table, slot, slots_of, workers_import
from strata.session import scratch_path

BREAK = "\r\n"
#: Equal payloads of fewer bytes are stored again.
MIN_BYTES = 100
#: Records of an archive, so that one of them never outgrows a task.
MAX_RECORDS = 50_000
#: Bytes that are inflated at a time, and bytes of members that are passed on at a time.
INPUT, PIECE = 1 << 16, 1 << 20


def tag_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: the record is a response).

    The least id of each repeated payload is found by combining (digest, id) rows
    before the shuffle; pages whose digest can't be repeated pass unshuffled, and
    a payload that a third of the pages share is joined, which Spark can split."""
    p = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"),
                     F.coalesce(col(html_col), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    big = p.where(F.octet_length("payload") >= min_bytes)
    twice = (big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                .where("n > 1 and first is not null").select("digest", "first"))
    s = p.withColumn("slot", slot(F.col("digest")))
    slots = slots_of(twice, "digest")
    none = F.lit(None).cast("long")
    single = s.join(slots, "slot", "left_anti").withColumn("first", none)
    other = s.join(slots, "slot", "left_semi").join(twice, "digest", "left")
    both = single.unionByName(other)
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "payload", "digest",
                       F.when(F.col("first").isNotNull() & again, F.col("first")).alias("refers_to"))


def records(tagged: DataFrame) -> DataFrame:
    """One column, ``value``: each record without the blank lines that end it."""
    again = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        BREAK, F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.octet_length("payload")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, 0).otherwise(F.octet_length("payload"))))
    return tagged.select(F.concat(head, F.lit(BREAK * 2), F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write_monolithic(tagged: DataFrame, path: str, max_records: int = MAX_RECORDS) -> None:
    """Archives under ``path``, each a single gzip stream."""
    (records(tagged).write.option("lineSep", BREAK * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", max_records).text(path))


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each with the blank lines that end it."""
    held = bytearray()
    end_of_head = b"\r\n\r\n"
    need, head = 0, -1
    for piece in pieces:
        held += piece
        while True:
            if head < 0:
                head = held.find(end_of_head)
                if head < 0:
                    break
                need = head + 4 + int(headers(bytes(held[:head]))["content-length"]) + 4
            if len(held) < need:
                break
            record = bytes(held[:need])
            if record[-4:] != end_of_head:
                raise ValueError("a record does not end with two line breaks")
            yield record
            del held[:need]
            head = -1
    if held:
        raise ValueError("the stream ends inside a record")


def inflate(content: bytes) -> Iterator[bytes]:
    """A gzip file in pieces, read once from front to end, whatever its members."""
    at = 0
    while at < len(content):
        z = zlib.decompressobj(wbits=31)
        while not z.eof:
            if at >= len(content):
                raise ValueError("the gzip stream is cut off")
            out = z.decompress(content[at:at + INPUT])
            at += INPUT
            if out:
                yield out
        at = min(at, len(content)) - len(z.unused_data)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split(BREAK)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, wbits=31)
    return z.compress(record) + z.flush()


_MEMBER = "archive string, record long, offset long, length long, record_id string, member binary"


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("record", pa.int64()), ("offset", pa.int64()),
                        ("length", pa.int64()), ("record_id", pa.string()), ("member", pa.binary())])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            archive, offset, size, rows = path.as_py().rsplit("/", 1)[-1], 0, 0, []
            for i, record in enumerate(split_records(inflate(content.as_py()))):
                name = headers(record[:record.index(b"\r\n\r\n")])["warc-record-id"]
                m = member(record)
                rows.append((archive, i, offset, len(m), name, m))
                offset, size = offset + len(m), size + len(m)
                if size >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    size, rows = 0, []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Every archive under ``source`` rewritten under ``target``/members, a record a member,
    and the sidecar index under ``target``/index."""
    workers_import(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    files.mapInArrow(_normalised, _MEMBER).write.parquet(f"{target}/members")
    members = spark.read.parquet(f"{target}/members")
    members.drop("member").write.parquet(f"{target}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda v: int(x) if v and (x := v.removeprefix("<urn:page:").rstrip(">")) else None
    for batch in batches:
        rows = []
        for m in batch.column(0):
            record = zlib.decompress(m.as_py(), wbits=31)
            head = record.index(b"\r\n\r\n")
            h = headers(record[:head])
            digest, size = h["warc-payload-digest"].removeprefix("sha256:"), int(h["warc-payload-length"])
            if h["warc-type"] == "response":
                payload = record[head + 4:-4]
                if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                    raise ValueError(f"payload of {h['warc-record-id']} is not what its headers say")
            rows.append((number(h["warc-record-id"]), size, digest, h["warc-type"], number(h.get("warc-refers-to"))))
        columns = zip(*rows) if rows else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    workers_import(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.parquet(f"{target}/members").select("member").mapInArrow(_read, schema)


def read_records(spark: SparkSession, target: str, record_ids: DataFrame) -> DataFrame:
    """The records of these ids (a column ``record_id``), as ``read_archives`` gives them: their
    places are looked up in the index, and only the members at those places are inflated."""
    workers_import(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    index = spark.read.parquet(f"{target}/index")
    places = index.join(record_ids.select("record_id").distinct(), "record_id").select("archive", "offset", "length")
    members = spark.read.parquet(f"{target}/members").select("archive", "offset", "length", "member")
    return members.join(places, ["archive", "offset", "length"]).select("member").mapInArrow(_read, schema)


def op6_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = scratch_path(spark, "warc"), scratch_path(spark, "warc-members")
    write_monolithic(tag_revisits(read_table(spark, sf_dir, "pages")), source)
    normalise(spark, source, target)
    return read_archives(spark, target)


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
