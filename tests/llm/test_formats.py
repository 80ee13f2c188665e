"""Chat examples and WARC archives: round trips against plain Python."""

import gzip
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from strata.llm import chat_prefixes as C
from strata.llm import warc_normalise as W
from strata.session import scratch_path

SCHEMA = "conv_id long, turn long, role string, text string, line string, stop int"


def plain(rows):
    convs = {}
    key = lambda x: (x is not None, x)
    for c, turn, role, text, *_ in sorted(rows, key=lambda r: (key(r[1]), r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


HARD = ["~", "~0~1", "<|end|>", "<|start|>assistant<|text|>", "<", "|", "<|", "~<|", "</s>[INST] ok [/INST]", "<<|end|>", "\n",
        "é😀<|text|>", "", None, "x" * 100_000, "<|en", "d|>"]


def test_round_trip_of_hard_texts(spark):
    rows = [(1, i, r, t, "z", 9) for i, t in enumerate(HARD) for r in ("user", "assistant")]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, None, None, "n"),
             (None, 1, "assistant", "<|end|>"), (4, 0, "<|end|>", "x")]
    rows = [(*r, None, None)[:6] for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    ex = C.prefix_targets(df)
    back = C.read_back(ex)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    got = {r.conv: (r.n, r.told, r.chars, r.loss) for r in back.select(
        "conv", F.size("turns").alias("n"), F.sha2(told, 256).alias("told"), F.length("loss").alias("chars"),
        F.sha2("loss", 256).alias("loss")).collect()}
    assert got == plain(rows)
    e = {(r.conv, r.example): r for r in ex.collect()}
    assert e[2, 0].loss_start is None and (2, 1) not in e
    first = e[1, 0]
    assert first.text[first.loss_start:first.loss_end] == "~0" and first.text.endswith("<|end|>")
    assert sum(1 for c, _ in e if c == 3) == 2
    assert C.read_back(C.prefix_targets(df.limit(0))).count() == 0


def test_chat_query_is_native_and_whole(spark, docs_dir):
    df = C.op5_chat_prefixes(spark, docs_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
    rows = [tuple(r) for r in spark.read.parquet(f"{docs_dir}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}
    assert got == plain(rows)


def plain_records(pages):
    first = {}
    for i, _, h, *_ in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h, *_ in pages:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 200
    pages = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (9, "u", big), (3, "u", big),
             (None, "u", big), (1, "u", None), (2, "u", ""), (4, "u", "s" * 99), (6, "u", "s" * 99),
             (7, "u", "t" * 100), (8, "u", "t" * 100), (None, "u", "q" * 300), (10, "u", "\r\n\r\n"),
             (11, "u", "\x00\n" * 300_000)]
    df = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, slot int")
    source, target = scratch_path(spark, "w"), scratch_path(spark, "m")
    W.write_monolithic(W.tag_revisits(df), source, max_records=4)
    W.normalise(spark, source, target)
    got = sorted((tuple(r) for r in W.read_archives(spark, target).collect()), key=str)
    assert got == plain_records(pages)
    # the sidecar index finds each record in its normalised file, and that file is valid as a whole
    members = spark.read.parquet(f"{target}/members").orderBy("archive", "offset").collect()
    files = {}
    for m in members:
        assert m.offset == len(files.setdefault(m.archive, b""))
        files[m.archive] += m.member
    for r in spark.read.parquet(f"{target}/index").collect():
        record = zlib.decompress(files[r.archive][r.offset:r.offset + r.length], wbits=31)
        assert f"WARC-Record-ID: {r.record_id}\r\n".encode() in record
    for name, whole in files.items():
        with gzip.open(os.path.join(source.removeprefix("file:"), name)) as f:
            assert gzip.decompress(whole) == f.read()


def test_records_are_read_by_their_places_in_the_index(spark):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 30) for i in range(9)], "page_id long, url string, html string")
    source, target = scratch_path(spark, "w"), scratch_path(spark, "m")
    W.write_monolithic(W.tag_revisits(df), source, max_records=4)
    W.normalise(spark, source, target)
    index = spark.read.parquet(f"{target}/index")
    asked = index.where("record_id in ('<urn:page:3>', '<urn:page:7>')").select("record_id")
    got = sorted(tuple(r) for r in W.read_records(spark, target, asked.union(asked)).collect())
    assert got == sorted(tuple(r) for r in W.read_archives(spark, target).where("page_id in (3, 7)").collect())
    assert len(got) == 2
    assert W.read_records(spark, target, asked.limit(0)).count() == 0


def test_warc_stream_errors_and_pieces():
    record = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    assert list(W.split_records(iter([record[:20], record[20:] + record[:5], record[5:]]))) == [record] * 2
    with pytest.raises(ValueError):
        list(W.split_records(iter([record[:-1]])))
    z = gzip.compress(record) + gzip.compress(b"") + gzip.compress(record * 9000)
    assert b"".join(W.inflate(z)) == record * 9001
    with pytest.raises(ValueError):
        list(W.inflate(z[:-4]))


def test_warc_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    source, target = scratch_path(spark, "w"), scratch_path(spark, "m")
    W.write_monolithic(W.tag_revisits(df), source)
    W.normalise(spark, source, target)
    assert W.read_archives(spark, target).count() == 0


def test_warc_query(spark, docs_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{docs_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in W.op6_warc_normalise(spark, docs_dir).collect()), key=str) == plain_records(pages)
