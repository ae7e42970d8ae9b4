"""WARC archives: a writer that stores each payload once, and a splittable reader.

Reading: an archive is cut into byte ranges, one row each, and tasks open the archive themselves. A task
scans its range for the gzip magic; a candidate counts if it decompresses to a WARC header block. A task
owns the records that start inside its range and reads the last one past the range's end, so each record is
read once, whatever the ranges. From a record's end the reader goes straight on to the next member, and only
scans byte by byte where that fails.

Writing: tasks write archives of their own with random names to a shared folder and return a row for each.
Only archives of those rows are read, so a repeated or lost task leaves files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
MOST_TASKS = 20_000
_FILES = "path string, size long, records long"
_SPLITS = "path string, size long, start long, stop long"
RECORDS = (
    "path string, offset long, next_offset long, type string, record_id string, refers_to string, uri string, "
    "declared_digest string, content_type string, http_head string, payload binary, payload_digest string"
)


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store, name


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return z.compress(data) + z.flush()


def _safe(text: str) -> str:
    """A header value on one line; what would break it is percent-encoded."""
    return quote(text, safe="!#$%&'()*+,/:;=?@[]~ -._<>|{}^`\"\\")


def record(page_id: int | None, uid: int | str, url: str | None, payload: bytes, refers_to: str | None, known: tuple[int, str] | None = None) -> bytes:
    """A response, or a revisit of ``refers_to`` without payload, as one gzip member; ``known``: a revisit's payload bytes and digest."""
    size, sha = known or (len(payload), digest(payload))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{uid}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _member(head, http + (payload if refers_to is None else b""))


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        out, path, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{path}", "size": size, "records": n}])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "uid", "refers", "size", "sha1"))
            for page, url, uid, refers_to, bytes_, sha, html in zip(*columns, batch.column("html"), strict=True):
                if out is None:
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{path}", compression=None)
                known = None if refers_to is None else (bytes_, base64.b32encode(bytes.fromhex(sha)).decode())
                data = record(page, uid, url, html.as_buffer().to_pybytes() if refers_to is None else b"", refers_to, known)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def with_responses(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``pages`` (key, page_id, ...) with ``top``, and the stored tops (key, top).

    ``top`` has the largest page_id of the rows with the key, null less than all, and how many rows have it. Rows
    are told by what they hold, never by number: numbers of rows may change from one read to the next, as
    when executors are lost.
    """
    # partial aggregates: a payload that a third of the pages share arrives as a row from each task
    each = pages.groupBy("key", "page_id").agg(F.count("*").alias("rows"))
    top = stored(each.groupBy("key").agg(F.max(F.struct("page_id", "rows")).alias("top")), "responses")
    # stored first: both sides of the join then are plain exchanges, and Spark splits the payload that has too many rows
    return pages.join(top, "key"), top


def _repeated(pages: DataFrame, top: DataFrame) -> DataFrame:
    """(page_id, url, html, response) for rows that repeat their payload's largest page_id: of each payload one is the response.

    They are counted by url, and as many rows made anew, in bounded runs; the response has the smallest url.
    """
    many = pages.join(top.where("top.rows > 1"), "key").where(F.col("page_id").eqNullSafe(F.col("top.page_id")))
    counted = stored(many.groupBy("key", "page_id", "url").agg(F.count("*").alias("rows"), F.first("html").alias("html"), F.first("size").alias("size")), "repeated")
    place = F.struct(F.col("url").isNotNull().alias("has"), "url")
    first = counted.groupBy("key").agg(F.min(place).alias("least"))
    marked = counted.join(first, "key").withColumn("is_first", F.col("least").eqNullSafe(place)).drop("least")
    responses = marked.where("is_first").select("page_id", "url", "html", "size", "key", F.lit(True).alias("response"))
    left = F.col("rows") - F.col("is_first").cast("long")
    runs = marked.select("page_id", "url", "size", "key", F.explode(F.sequence(F.lit(0).cast("long"), left, F.lit(10_000).cast("long"))).alias("at"), left.alias("left"))
    runs = runs.select("page_id", "url", "size", "key", F.least(F.col("left") - F.col("at"), F.lit(10_000)).cast("int").alias("n")).repartition("key", "url", F.rand(1))
    others = runs.select("page_id", "url", F.lit("").alias("html"), "size", "key", F.explode(F.array_repeat(F.lit(False), F.col("n"))).alias("response"))
    return responses.unionByName(others)


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = 1 << 30, least_bytes: int = 0) -> DataFrame:
    """Archives of (page_id, url, html) as (path, size, records); the payload is the html in UTF-8, null an empty one.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest page_id (null is
    less than all) becomes a response and the others revisit it; smaller ones are all responses. Of repeated
    rows with that page_id one is the response. Payloads and urls may have any length that a row can
    have; a record is compressed in memory. No rows: no archives. Further columns are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).withColumn("size", F.octet_length("html").cast("long"))
    long = rows.where(F.col("size") >= least_bytes).select(F.sha1(F.col("html").cast("binary")).alias("key"), "*")
    joined, top = with_responses(long)
    name: Column = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("key"), F.lit(">"))
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id"))
    refers = F.when(~is_top, F.concat(F.lit("<urn:page:"), F.coalesce(F.col("top.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("key"), F.lit(">")))
    done = joined.where(~is_top | (F.col("top.rows") == 1)).select("page_id", "url", "html", "size", "key", is_top.alias("response"), refers.alias("refers"))
    if least_bytes > 0:
        none = F.lit(None).cast("string")
        done = done.unionByName(rows.where(F.col("size") < least_bytes).select("*", none.alias("key"), F.lit(True).alias("response"), none.alias("refers")))
    if not top.where("top.rows > 1").isEmpty():
        done = done.unionByName(_repeated(long, top).withColumn("refers", F.when(~F.col("response"), name)))
    # a response that others refer to is named by its payload; all other records by a number that is theirs in this write
    named = F.coalesce(F.when(F.col("response"), F.col("key")), F.monotonically_increasing_id().cast("string"))
    payload = F.when(F.col("response"), F.col("html")).otherwise(F.lit("")).cast("binary")
    done = done.select("page_id", "url", payload.alias("html"), "size", F.col("key").alias("sha1"), named.alias("uid"), "refers")
    return stored(done.mapInArrow(_writer(folder, archive_bytes), _FILES), "archives")


class _Source:
    """Reads a file forward from any place, a chunk at a time."""

    def __init__(self, file, size: int, chunk: int = 1 << 18):
        self.file, self.size, self.chunk = file, size, chunk
        self.at, self.data = 0, b""

    def piece(self, start: int) -> bytes:
        """Some bytes from ``start`` on; none at the end."""
        if not self.at <= start < self.at + len(self.data):
            if start >= self.size:
                return b""
            self.file.seek(start)
            self.at, self.data = start, self.file.read(min(self.chunk, self.size - start))
        return self.data[start - self.at :] if start > self.at else self.data

    def find_magic(self, start: int, stop: int) -> int:
        """The next magic that starts in [start, stop), or -1."""
        while start < stop:
            data = self.piece(start)
            if len(data) < len(MAGIC):  # the end of a chunk: read it together with what follows
                self.data = b""
                data = self.piece(start)
                if len(data) < len(MAGIC):
                    return -1
            k = data.find(MAGIC)
            if k >= 0:
                return start + k if start + k < stop else -1
            start += len(data) - len(MAGIC) + 1
        return -1


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def _read_member(source: _Source, start: int) -> tuple[int, bytes, dict[str, str]] | None:
    """(end, block, headers) of the record at ``start``; None if what starts there isn't one."""
    z, whole, at, head, body = zlib.decompressobj(31), bytearray(), start, None, 0
    try:
        while not z.eof:
            data = source.piece(at)
            if not data:
                return None  # cut off
            seen = max(0, len(whole) - 3)
            whole += z.decompress(data)
            at += len(data) - len(z.unused_data)
            if head is None:  # judge a candidate by its first bytes, before reading all of it; a header block may have any length
                if not whole.startswith(b"WARC/1."[: len(whole)]):
                    return None
                end = whole.find(b"\r\n\r\n", seen)
                if end >= 0:
                    head, body = _headers(bytes(whole[:end])), end + 4
                    if "warc-type" not in head or not head.get("content-length", "").isdigit():
                        return None
    except zlib.error:
        return None
    if head is None:
        return None
    n = int(head["content-length"])
    return (at, bytes(whole[body : body + n]), head) if len(whole) >= body + n else None


def records_in(file, size: int, start: int, stop: int) -> Iterator[tuple[int, int, bytes, dict[str, str]]]:
    """(offset, end, block, headers) of the records that start in [start, stop)."""
    source, at = _Source(file, size), start
    while at < stop:
        at = source.find_magic(at, stop)
        if at < 0:
            return
        got = _read_member(source, at)
        if got is None:
            at += 1
        else:
            end, block, head = got
            yield at, end, block, head
            at = end


def _reader(splits: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.binary(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for some in splits:
        for split in some.to_pylist():
            store, name = _open(split["path"])
            rows, held = [], 0
            with store.open_input_file(name) as file:
                for at, end, block, head in records_in(file, split["size"], split["start"], split["stop"]):
                    http, payload = "", block
                    if head.get("content-type", "").startswith("application/http"):
                        cut = block.find(b"\r\n\r\n")
                        http, payload = block[: cut + 2].decode("latin-1"), block[cut + 4 :]
                    rows.append((split["path"], at, end, head["warc-type"], head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("content-type"), http, payload, digest(payload)))
                    held += len(payload) + len(http) + sum(map(len, head.values()))
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """Records of the archives (path, size), with columns as in ``RECORDS``; payloads are without HTTP headers.

    Members that aren't WARC records, cut-off members and bytes between members are passed over. A nested
    archive that a member stores uncompressed could be taken for records by a range that starts inside it.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = files.select("path", "size", starts.alias("start"))
    splits = splits.select("path", "size", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("stop"))
    # a stated number of tasks, as Spark would put rows this small into one
    return splits.repartition(max(1, min(MOST_TASKS, splits.count()))).mapInArrow(_reader, RECORDS)


def check_counts(files: DataFrame, rows: DataFrame) -> None:
    """Raises where ``rows`` (path, ...) aren't as many of each archive as the manifest (path, records) says."""
    read = rows.groupBy("path").agg(F.count("*").alias("got"))
    wrong = files.select("path", "records").join(read, "path", "left").where(F.coalesce("got", F.lit(0)) != F.col("records")).first()
    if wrong:
        raise RuntimeError(f"{wrong.path}: {wrong.got or 0} of {wrong.records} records read")


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 64 << 20, split_bytes: int = 4 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages written to archives and read back.

    A response's figures come from the payload that was read; a revisit has none, so they come from its headers.
    As many records must be read as were written.
    """
    files = write_archives(pages, archive_bytes=archive_bytes, least_bytes=least_bytes)
    got = read_archives(files, split_bytes)
    page = lambda c: F.nullif(F.split_part(F.col(c), F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    response = F.col("type") == "response"
    declared = F.regexp_extract("http_head", r"(?i)\r\ncontent-length: *(\d+)", 1)
    rows = got.select(
        "path",
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.nullif(declared, F.lit("")).cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, F.col("payload_digest")).otherwise(F.replace("declared_digest", F.lit("sha1:"), F.lit(""))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
    rows = stored(rows, "records")
    check_counts(files, rows)
    return rows.drop("path")
