import gzip
import io
import random

import pytest
from oracle import SF, compare
from pyspark.sql import functions as F

from pagemill.llm import queries, warc

SCHEMA = "page_id long, url string, html string, key string, uid long, top string"


def pages(spark, rows, partitions=2):
    return spark.createDataFrame([(*r, "k", 1, "t") for r in rows], SCHEMA).repartition(partitions)


def test_query(spark):
    assert compare(queries.op5_warc(spark, SF), queries.ORACLE_SQL["op5_warc"]) == 250


def test_awkward(spark):
    long = "".join(random.Random(1).choice("abcdef <>\r\n\x1f") for _ in range(400_000))
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u\r\nWARC-Type: evil", None), (4, "é", ""), (None, "n", "x"), (5, "same", "x"), (5, "same", "x"), (6, "l", long), (7, "h", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "m", "only null"), (None, "m", "only null")]
    df = pages(spark, rows).cache()
    got = warc.round_trip(df, archive_bytes=1000, split_bytes=700).collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert sorted(kinds[5]) == [("response", None, 1), ("revisit", 5, 1)]
    assert kinds[1] == [("revisit", 5, 1)] and kinds[2] == [("revisit", 5, 1)]
    assert kinds[3] == [("revisit", 4, 0)] and kinds[4] == [("response", None, 0)]
    assert sorted(kinds[None], key=repr) == [("response", None, 9), ("revisit", 5, 1), ("revisit", None, 9)]
    for r in got:
        texts = {warc.digest((h or "").encode()) for p, _, h in rows if p == r.page_id}
        assert r.payload_digest in texts
    assert warc.round_trip(pages(spark, [])).count() == 0
    plain = warc.round_trip(df, least_bytes=2).collect()
    assert sum(r.record_type == "revisit" for r in plain) == 1


def records(data, size):
    out = []
    for start in range(0, len(data), size):
        out += [(at, head["warc-record-id"], block) for at, _, block, head in warc.records_in(io.BytesIO(data), len(data), start, min(len(data), start + size))]
    return out


def test_ranges_own_each_record_once():
    """Every split size, payloads with the magic inside, members that aren't records, garbage and a cut-off end."""
    r = random.Random(5)
    payloads = [bytes(r.randrange(256) for _ in range(r.randrange(300))) + warc.MAGIC * r.randrange(3) for _ in range(12)]
    members = [warc.record(k, k, f"http://x/{k}", p, None) for k, p in enumerate(payloads)]
    data = b"".join(members)
    whole = records(data, len(data))
    assert [x[1] for x in whole] == [f"<urn:page:{k}:{k}>" for k in range(12)]
    assert all(x[2].endswith(p) for x, p in zip(whole, payloads, strict=True))
    for size in (1, 2, 3, 7, 64, 500, 1999):
        assert records(data, size) == whole
    dirty = gzip.compress(b"no record") + members[0] + b"\x1f\x8b\x08 garbage" + members[1] + b"WARC/1.1" + members[2][:-9]
    for size in (5, 100, 10_000):
        assert [x[1] for x in records(dirty, size)] == ["<urn:page:0:0>", "<urn:page:1:1>"]


def test_magic_across_chunks():
    data = b"a" * 9 + warc.MAGIC + b"b" * 5
    source = warc._Source(io.BytesIO(data), len(data), chunk=10)
    assert source.find_magic(0, len(data)) == 9
    assert source.find_magic(10, len(data)) == -1


def test_stored_members_and_other_writers(spark, tmp_path):
    """Members without compression and archives by other means are read as well."""
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    member = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:page:8:1>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    path = tmp_path / "other.warc.gz"
    path.write_bytes(gzip.compress(member, 0) + gzip.compress(member.replace(b":8:", b":9:"), 9))
    files = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, size long")
    got = warc.read_archives(files, 50).orderBy("offset").collect()
    assert [bytes(r.payload) for r in got] == [b"hello", b"hello"] and got[0].next_offset == got[1].offset


def test_long_urls(spark):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/é"
    url = lambda n: "data:text/html;base64," + "".join(r.choices(letters, k=n))
    rows = [(k, url(n), f"page {k}") for k, n in enumerate((10, 70_000, 400_000, 80_000, 900_000, 90_000, 100_000, 5))]
    got = warc.round_trip(pages(spark, rows, 1)).collect()
    assert sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type) for x in got) == [(k, 6, warc.digest(h.encode()), "response") for k, _, h in rows]
    data = b"".join(warc.record(k, k, u, h.encode(), None) for k, u, h in rows)
    for size in (50_000, len(data)):
        assert [x[1] for x in records(data, size)] == [f"<urn:page:{k}:{k}>" for k in range(len(rows))]


def test_counts_are_compared(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    files = lambda *x: spark.createDataFrame(x, "path string, size long, records long")
    warc.check_counts(files(("a", 9, 2), ("b", 9, 1)), rows)
    for wrong in (("a", 9, 3), ("c", 9, 1)):
        with pytest.raises(RuntimeError):
            warc.check_counts(files(wrong), rows)


def test_large_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    rows = [(big, "a", "x"), (None, "b", "y"), (big + 2, "c", "z"), (-big, "d", "x"), ((1 << 63) - 1, "e", "z"), (-(1 << 63), "f", "w")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows, 1)).collect()), key=repr)
    want = [(big, "response", None), (None, "response", None), (big + 2, "revisit", (1 << 63) - 1), (-big, "revisit", big), ((1 << 63) - 1, "response", None), (-(1 << 63), "response", None)]
    assert got == sorted(want, key=repr)


def test_a_payload_of_a_third_of_the_pages_is_split(spark):
    """The join with the chosen responses may be split by Spark, as both sides are exchanges of their own."""
    keys = ["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor"]
    before = {k: spark.conf.get(k) for k in keys}
    r = random.Random(3)
    rows = [(k, f"http://{r.getrandbits(1600)}", "hot " * 50 if k % 3 == 0 else f"page {k}") for k in range(6000)]
    df = pages(spark, rows, 12)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/hot-pages")
    try:
        for k, v in zip(keys, ("20k", "20k", "-1", "1.5"), strict=True):
            spark.conf.set(k, v)
        joined, _ = warc.with_responses(spark.read.parquet(path).select(F.sha1(F.col("html").cast("binary")).alias("key"), "page_id", "url", "html"))
        assert len(joined.collect()) == 6000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_that_repeat_the_largest_id(spark):
    """Of rows that share payload and largest id one is the response, whatever their urls and number; the others revisit it."""
    rows = [(9, f"u{k % 3}" if k % 4 else None, "same") for k in range(25_000)] + [(3, "a", "same"), (None, "a", "none"), (None, "b", "none"), (1, "x", "one")]
    got = {}
    for r in warc.round_trip(pages(spark, rows, 3)).collect():
        got[r.page_id, r.record_type, r.refers_to] = got.get((r.page_id, r.record_type, r.refers_to), 0) + 1
        assert r.payload_bytes == (3 if r.page_id == 1 else 4)
    assert got == {(9, "response", None): 1, (9, "revisit", 9): 24_999, (3, "revisit", 9): 1, (None, "response", None): 1, (None, "revisit", None): 1, (1, "response", None): 1}


def test_numbers_of_rows_may_change_between_reads(spark, tmp_path):
    """Parts of a table are cut anew for each job, as happens when executors come or go; the result doesn't change."""
    rows = [(k, f"http://{k}", f"page {k % 700} " * 20) for k in range(2000)]
    pages(spark, rows, 4).write.parquet(path := f"{tmp_path}/pages")
    key, seen = "spark.sql.files.maxPartitionBytes", []
    before, real = spark.conf.get(key), warc.stored

    def other_parts(df, name):
        out = real(df, name)
        spark.conf.set(key, "3000")
        return out

    try:
        for store in (real, other_parts):
            warc.stored = store
            spark.conf.set(key, before)
            seen.append(sorted(warc.round_trip(spark.read.parquet(path)).collect(), key=repr))
    finally:
        warc.stored = real
        spark.conf.set(key, before)
    assert seen[0] == seen[1] and len(seen[0]) == 2000 and sum(r.record_type == "response" for r in seen[0]) == 700
