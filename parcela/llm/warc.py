"""WARC archives by index: writing records with an index row each, and coalesced byte-range reads of selected records.

Every record is a gzip member of its own. Its index row has the file, offset, length, URL and digest, so a reader needs no
archive to choose records: it takes the chosen index rows in order of file and offset, joins ranges that lie close
together into one read, and decompresses only the members asked for. The index is a Parquet table; rows of tasks that
failed or ran twice never reach it, so archives that only they wrote are ignored.

Of records with equal payloads of at least REVISIT_BYTES, the one with the largest page_id is a response and the others
are revisits without payload that refer to it. Null page_ids rank below all others; rows that share the largest page_id
are each a response.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import written
from parcela.sources.shared import scratch

REVISIT_BYTES = 1000
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 256_000_000
#: Ranges with a gap up to this are read together, up to that many bytes at once.
GAP_BYTES, READ_BYTES = 64_000, 8_000_000
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
INDEX_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def safe_url(url: str | None, page_id: int | None) -> str:
    """The URL with white space and control characters escaped; a page without one gets a urn of its id."""
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'' if page_id is None else page_id}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def fields(pairs: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; without payload a revisit."""
    http = b"HTTP/1.1 200 OK\r\n" + fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]) + b"\r\n"
    block = http + (payload or b"")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if payload is None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", refers_to)]
    head += [("Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + fields(head) + b"\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """The data as a gzip member."""
    gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP fields and payload of one uncompressed record."""
    named = lambda block: {k.lower(): v for k, _, v in (line.partition(": ") for line in block.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = named(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, named(http), payload


def with_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, size, digest and refers_to (null for responses) of every row.

    Pages below REVISIT_BYTES meet nothing. Of the others a table of ids and digests is written, in which a digest meets
    the largest page_id that has it; payloads then meet the revisits among them by page_id and digest, so that a payload
    that many pages share doesn't gather in one task.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    small, large = rows.where(F.col("size") < REVISIT_BYTES), rows.where(F.col("size") >= REVISIT_BYTES)
    facts = written(large.select("page_id", "digest"), "facts")
    first = facts.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = facts.join(first, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = revisits.select(F.col("page_id").alias("own"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct()
    met = large.join(revisits, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left")
    every = met.select(*rows.columns, "refers_to").unionByName(small.withColumn("refers_to", F.lit(None).cast("long")))
    return every.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row of with_types() into archives below the path; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page, url, payload, size, digest, refers in zip(*(batch.column(i) for i in range(6)), strict=True):
                page, refers = page.as_py(), refers.as_py()
                address = safe_url(url.as_py(), page)
                if out is None or at >= archive_bytes:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = packed(record(page, address, payload.as_py(), size.as_py(), digest.as_py(), refers))
                out.write(data)
                index.append((name, at, len(data), address, digest.as_py(), page, "response" if refers is None else "revisit"))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True) if index else [[]] * len(INDEX_SCHEMA), INDEX_SCHEMA, strict=True)], schema=INDEX_SCHEMA)
        if out:
            out.close()

    rows.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return rows.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, int]]:
    """Reads that cover sorted ranges (offset, length): offset, length and the number of ranges in it."""
    begin = end = n = 0
    for offset, length in ranges:
        if n and (offset - end > gap or offset + length - begin > most):
            yield begin, end - begin, n
            n = 0
        if not n:
            begin = end = offset
        end, n = max(end, offset + length), n + 1
    if n:
        yield begin, end - begin, n


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(index: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records of these index rows, in READ's columns; payload is null for revisits, or if not asked for.

    A response's size and digest are taken from the payload itself, a revisit's from its fields. Index rows are dealt by
    archive, which is bounded in size, and read in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        system, base = fs.FileSystem.from_uri(path)
        source, name = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            first = 0
            while first < len(rows):
                last = next((i for i in range(first, len(rows)) if rows[i][0] != rows[first][0]), len(rows))
                if rows[first][0] != name:
                    name = rows[first][0]
                    source = system.open_input_file(f"{base}/{name}")
                for begin, length, n in coalesced([r[1:] for r in rows[first:last]]):
                    source.seek(begin)
                    data, out = source.read(length), []
                    for _, offset, size in rows[first : first + n]:
                        warc, http, payload = parsed(zlib.decompress(data[offset - begin : offset - begin + size], 31))
                        number = lambda key, of=warc: int(of[key]) if key in of else None
                        if warc["warc-type"] == "response":
                            facts = (len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload if with_payload else None)
                        else:
                            facts = (int(http["content-length"]), base64.b32decode(warc["warc-payload-digest"][5:]).hex(), "revisit", number("refers-to-page-id"), None)
                        out.append((number("page-id"), warc["warc-target-uri"], *facts))
                    first += n
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the index rows are small, the records aren't
    ordered = index.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, READ)


def archived(pages: DataFrame, path: str | None = None, with_payload: bool = False, **names: str) -> DataFrame:
    """Writes all pages as archives and reads every record back.

    A null html is an empty payload; a page without URL gets a urn; null page_ids rank below all others, and rows that share
    the largest page_id of a payload are each a response. Repeated rows each keep their record; an empty table gives an
    empty result. Only the three named columns are read, so other columns' names don't matter.
    """
    path = path or scratch(pages.sparkSession, "warc")
    return read_records(write_archives(with_types(pages, **names), path), path, with_payload)
