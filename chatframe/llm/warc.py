"""WARC archives written and read by tasks, payloads as rows of chunks.

A payload never has to be whole in a Python task: it is a run of rows ``(record, chunk
number, bytes)``.  The writer streams the chunks of a record into its own gzip member; the
reader streams a member into chunks and carries the SHA-256 and the length up to each.

Of payloads that are equal and have at least ``min_revisit`` bytes, the one with the
smallest ``page_id`` is a response and the others are revisits of it, without a payload.
All smaller payloads are responses.

A null payload is an empty one.  A null ``page_id`` is larger than any other and reads back
as null.  Rows that share the smallest ``page_id`` are all responses.  Equal rows are
records of their own.  An empty table makes no archive.  Other columns are ignored.

No two records share a ``WARC-Record-ID``.  That of a response with revisits is a hash of
its page and digest, which a revisit names; every other one is a hash of file and offset.
Where several rows share the smallest ``page_id`` of a digest, none of them can be named:
their revisits carry the digest alone and are resolved by it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import fresh_folder, stored
from chatframe.llm.files import existing, new_file

CHUNK = 256 * 1024
#: Fixed values of the archive format.
VERSION = b"WARC/1.1"
RESPONSE_TYPE = "application/http; msgtype=response"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """``(page_id, url, payload, size, digest, refers_to, revisit, named)`` for every page.

    ``named``: the page is a response that revisits name, or a revisit that names its response.

    Only ids and digests are grouped and joined; the group of a digest is reduced to its
    smallest id in the tasks first.  The payloads meet the few columns of the revisits by
    page, so a digest with very many copies is spread.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"),
    )
    large = stored(rows.filter(F.col("size") >= min_revisit).select("page_id", "digest", "size"), "digests")
    copies = large.groupBy("digest", "size", "page_id").agg(F.count("*").alias("n"))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))
    first = stored(
        copies.groupBy("digest", "size").agg(F.min(known).alias("first"), F.sum("n").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "size", F.col("first.page_id").alias("refers_to"), (F.col("first.n") == 1).alias("_named")),
        "responses",
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))
    marks = stored(
        large.join(first, ["digest", "size"]).filter(later | F.col("_named")).select(
            F.coalesce("page_id", F.lit(-1)).alias("_page"), F.col("page_id").isNull().alias("_none"),
            F.col("digest").alias("_digest"), F.when(later, F.col("refers_to")).alias("refers_to"), later.alias("_later"), "_named",
        ).distinct(),
        "revisits",
    )
    same = (
        (F.coalesce("page_id", F.lit(-1)) == F.col("_page"))
        & (F.col("page_id").isNull() == F.col("_none")) & (F.col("digest") == F.col("_digest"))
    )
    return rows.join(marks, same, "left").select(
        "page_id", "url", "payload", "size", "digest", "refers_to", F.coalesce("_later", F.lit(False)).alias("revisit"),
        F.coalesce("_named", F.lit(False)).alias("named"),
    )


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per chunk, in order: the columns of the record, ``chunk_no`` and ``chunk``."""
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    last = F.greatest(F.ceil(F.octet_length(body) / chunk), F.lit(1)) - 1
    numbers = F.explode(F.sequence(F.lit(0), last.cast("int")))  # one chunk at a time is cut off
    return records.withColumn("chunk_no", numbers).select(
        "page_id", "url", "size", "digest", "refers_to", "revisit", "named", "chunk_no",
        F.substring(body, F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"),
    )


def record_id(*parts: object) -> str:
    h = hashlib.md5(" ".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def header(
    page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool, named: bool, place: tuple, date: str
) -> bytes:
    """The head of a record at a ``place`` of its own, and of the response in it, up to the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest) if named and not revisit else record_id(*place),
        "WARC-Date": date,
        "WARC-Target-URI": " ".join(url.split()) if url else "",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": RESPONSE_TYPE,
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        fields |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(refers_to, digest) if named else ""}
    fields["Content-Length"] = str(len(http) + (0 if revisit else size))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + http


def write_archives(
    pages: DataFrame,
    min_revisit: int = 100,
    archive_bytes: int = 1 << 30,
    segment_bytes: int = 8 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write the archives; returns ``(path, offset, length, records)``, a row per segment.

    Segments are runs of whole records that can be read apart from each other.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])

    def write(batches):
        stream, member, at, begin, records = None, None, 0, 0, 0

        def segment():
            return pa.RecordBatch.from_pylist(
                [{"path": path, "offset": begin, "length": at - begin, "records": records}], schema=schema
            )

        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in range(8)))
            for (page_id, url, size, digest, refers_to, revisit, named, chunk_no), chunk in zip(heads, batch.column(8)):
                if chunk_no == 0:
                    if member is not None:
                        at += stream.write(member.compress(b"\r\n\r\n") + member.flush())
                        records += 1
                        if at - begin >= segment_bytes:
                            yield segment()
                            begin, records = at, 0
                            if at >= archive_bytes:
                                stream.close()
                                stream = None
                    if stream is None:
                        (stream, path), at, begin = new_file(folder, ".warc.gz"), 0, 0
                    member = zlib.compressobj(5, zlib.DEFLATED, 31)
                    at += stream.write(member.compress(header(page_id, url, size, digest, refers_to, revisit, named, (path, at), date)))
                at += stream.write(member.compress(chunk.as_py()))
        if member is not None:
            at += stream.write(member.compress(b"\r\n\r\n") + member.flush())
            records += 1
            yield segment()
        if stream is not None:
            stream.close()

    rows = chunked(planned(pages, min_revisit))
    return stored(rows.mapInArrow(write, "path string, offset long, length long, records long"), "segments")


# --- reading ------------------------------------------------------------------------------


class _Part(io.RawIOBase):
    """``length`` bytes of a file from ``offset``."""

    def __init__(self, file, offset: int, length: int):
        file.seek(offset)
        self.file, self.left = file, length

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode()
    return out


def chunks_of(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of the records in an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if line.rstrip(b"\r\n") != VERSION:
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        head = _fields(stream)
        left = int(head["content-length"])
        if head.get("content-type") == RESPONSE_TYPE:
            while left:
                line = stream.readline()
                left -= len(line)
                if not line.strip():
                    break
        record = {
            "record_id": head["warc-record-id"], "record_type": head["warc-type"],
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "url": head.get("warc-target-uri"),
            "refers_to_record": head.get("warc-refers-to"),
            "declared": head.get("warc-payload-digest", "").removeprefix("sha256:"),
        }
        running, n, number = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise ValueError("a record ends early")
            left -= len(data)
            running.update(data)
            n += len(data)
            yield record | {"chunk_no": number, "chunk": data, "bytes_so_far": n, "digest_so_far": running.hexdigest(), "last": not left}
            number += 1
            if not left:
                break


CHUNK_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("refers_to_record", pa.string()), ("declared", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()),
    ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
])


def read_chunks(segments: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives: a row per record and chunk number.

    ``bytes_so_far`` and ``digest_so_far`` cover the payload up to and with the chunk, so the
    row marked ``last`` has those of the whole payload.
    """

    def read(batches):
        for batch in batches:
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with existing(path) as file:
                    part = io.BufferedReader(_Part(file, offset, length), 1 << 20)
                    rows, waiting = [], 0
                    for row in chunks_of(io.BufferedReader(gzip.GzipFile(fileobj=part), 1 << 18), chunk):
                        rows.append(row)
                        waiting += len(row["chunk"])
                        if waiting >= 8 << 20 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_SCHEMA)
                            rows, waiting = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_SCHEMA)

    tasks = max(1, min(segments.count(), 10_000))
    return segments.select("path", "offset", "length").repartition(tasks).mapInArrow(
        read,
        "record_id string, record_type string, page_id long, url string, refers_to_record string, declared string,"
        " chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, last boolean",
    )


def records(chunks: DataFrame) -> DataFrame:
    """A row per record with the length and digest of its full payload; revisits are resolved.

    A response whose payload doesn't have the digest its head declares is an error.
    """
    ends = stored(chunks.filter("last").drop("chunk"), "records")
    checked = F.when(F.col("digest_so_far") == F.col("declared"), F.col("digest_so_far")).otherwise(
        F.raise_error(F.concat(F.lit("payload of another digest in "), "record_id"))
    )
    responses = ends.filter("record_type = 'response'").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), checked.alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"), "record_id",
    )
    revisits = ends.filter("record_type = 'revisit'")
    named = revisits.filter("refers_to_record is not null")
    referred = stored(
        responses.join(named.select(F.col("refers_to_record").alias("record_id")).distinct(), "record_id", "left_semi")
        .select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"),
        "referred",
    )
    unnamed = revisits.filter("refers_to_record is null")
    of_digest = stored(
        responses.join(unnamed.select(F.col("declared").alias("payload_digest")).distinct(), "payload_digest", "left_semi")
        .groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes")),
        "referred-digests",
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    by_name = named.join(
        referred.withColumnRenamed("record_id", "_referred"), F.col("refers_to_record") == F.col("_referred"), "left"
    )
    by_digest = unnamed.join(of_digest, F.col("declared") == F.col("payload_digest"), "left")
    return responses.select(columns).union(by_name.select(columns)).union(by_digest.select(columns))
