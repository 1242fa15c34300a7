"""WARC archives: written from a table of pages and read back, record by record, through tables of chunks.

A payload becomes chunk rows (record, chunk number, bytes) that carry the payload's SHA-1 and length up to each of them; the last row's are the record's. The writer appends the
chunks to a gzip member per record and digests them again; the reader streams members block by block into chunk rows of the same kind, and records are folded from
those. Apart from the row that a page arrives in, no step holds a record as a whole. A record whose payload equals that of another with a larger page id is a revisit
without a body; it names the response that it refers to, and its HTTP header states the full payload's length. Payloads are equal if their lengths and SHA-1 are;
their bytes are not compared, as the digest is what a revisit states.

Archives go to the shared folder of the session. A task writes files under names of its own and reports them in a manifest row; only files in the
manifest are read, so a task that is repeated leaves at most unread files behind.

Defined cases: a null payload is empty; payloads shorter than `least` bytes are always responses; rows that repeat the page id and the
payload of a response are responses themselves; a null page id is archived, revisits any page with the same payload, and is never referred to
while another id has that payload; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions.graph import checkpointed, shared_folder
from fixlake.llm.common import arrow_schema, bounded, table

#: Bytes of a chunk, and of what the reader takes from a file at a time.
CHUNK = 1 << 16
#: A task begins another archive beyond so many bytes.
ROLL = 1 << 29
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper halves of the record identifiers of pages with an id, and of those without one.
_SPACE, _NO_ID = 0x6669786C616B4000, 0x6669786C616B4001

#: Bytes and rows of a batch of the reader's.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096

MANIFEST = "path string, records long, bytes long"
WRITTEN = "page_id long, url string, record long, chunk_no long, last_chunk long, chunk binary, bytes_so_far long, digest_so_far string, bytes long, digest string"
READ = "page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, chunk binary, bytes_so_far long, digest_so_far string"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=((_NO_ID if page_id is None else _SPACE) << 64) | ((page_id or 0) & (1 << 64) - 1))}>"


def page_of(urn: str) -> int | None:
    number = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    low = number & (1 << 64) - 1
    return None if number >> 64 == _NO_ID else low - (1 << 64) if low >> 63 else low


def chunk_rows(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url", chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each page's payload, in order, with the length and digest up to it; one empty chunk for an empty payload."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"), F.monotonically_increasing_id().alias("record"),
        body.alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(WRITTEN)
        for batch in bounded(batches):
            page, link, record, data = batch.columns
            out = []
            for p, u, r, d in zip(page.to_pylist(), link.to_pylist(), record.to_pylist(), data, strict=True):
                view = memoryview(d.as_buffer())
                states, digest = [], hashlib.sha1()
                for at in range(0, max(1, len(view)), chunk):
                    digest.update(view[at : at + chunk])
                    states.append(base32_sha1(digest.digest()))
                for n, state in enumerate(states):
                    part = view[n * chunk : (n + 1) * chunk]
                    out.append((p, u, r, n, len(states) - 1, bytes(part), n * chunk + len(part), state, len(view), states[-1]))
                    if len(out) * chunk > BATCH_BYTES and len(states) > 1:  # a large record, a few chunks at a time
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)

    return rows.mapInArrow(run, WRITTEN)


def with_revisits(chunks: DataFrame, least: int) -> DataFrame:
    """Add refers_to to chunk rows: the page with the same payload that a record revisits, or null."""
    ends = chunks.where((F.col("chunk_no") == F.col("last_chunk")) & (F.col("bytes") >= least)).select("page_id", "bytes", "digest")
    same = ends.groupBy("digest", "bytes").agg(F.max("page_id").alias("same"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = chunks.join(same, ["digest", "bytes"], "left")
    joined = joined.withColumn("refers_to", F.when(~F.col("same").eqNullSafe(F.col("page_id")), F.col("same"))).drop("same")
    return joined.where("refers_to IS NULL OR chunk_no = 0")  # a revisit has no body


def _head(row: dict) -> bytes:
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "urn:none")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(row['page_id'])}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{row['digest']}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(row['refers_to'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str | None = "url", least: int = 0, chunk: int = CHUNK
) -> DataFrame:
    """Write the archives below `folder` (a URI) and return the manifest (path, records, bytes), checkpointed."""
    rows = with_revisits(chunk_rows(pages, key, payload, url, chunk), least).sortWithinPartitions("record", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at, digest = None, None, None, None
        done: list[tuple[str, int, int]] = []
        for batch in bounded(batches):
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None or done[-1][2] > ROLL:
                        if out is not None:
                            out.close()
                        files, at = pafs.FileSystem.from_uri(folder)
                        files.create_dir(at, recursive=True)
                        path = f"{at}/part-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(path, compression=None)
                        done.append((path, 0, 0))
                    gzip, digest = zlib.compressobj(1, wbits=31), hashlib.sha1()
                    data = gzip.compress(_head(row))
                else:
                    data = b""
                end = True
                if row["refers_to"] is None:
                    digest.update(row["chunk"])
                    data += gzip.compress(row["chunk"])
                    end = row["chunk_no"] == row["last_chunk"]
                    if base32_sha1(digest.digest()) != row["digest_so_far"]:
                        raise ValueError(f"record of page {row['page_id']}: chunk {row['chunk_no']} does not go on where the one before it ends")
                if end:
                    data += gzip.compress(b"\r\n\r\n") + gzip.flush()
                out.write(data)
                path, records, size = done[-1]
                done[-1] = (path, records + end, size + len(data))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": p, "records": r, "bytes": b} for p, r, b in done], schema=arrow_schema(MANIFEST))

    return checkpointed(rows.mapInArrow(run, MANIFEST))


def inflated(stream) -> Iterator[bytes]:
    """What a file of gzip members holds, block by block."""
    gzip = zlib.decompressobj(wbits=31)
    while block := stream.read(CHUNK):
        while block:
            if gzip.eof:
                gzip = zlib.decompressobj(wbits=31)
            while block and not gzip.eof:
                data = gzip.decompress(block, CHUNK)
                block = gzip.unconsumed_tail or gzip.unused_data
                if data:
                    yield data
    if not gzip.eof:
        raise ValueError("the archive ends within a record")


class _Source:
    """Bytes from an iterator of blocks, with a bounded look ahead."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """All bytes up to the mark, which is dropped; None at the end of the data."""
        while (k := self.held.find(mark)) < 0:
            block = next(self.blocks, None)
            if block is None:
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return None
            self.held += block
            if len(self.held) > most + 2 * CHUNK:
                raise ValueError("a header is too long")
        head, self.held = self.held[:k], self.held[k + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and (block := next(self.blocks, None)) is not None:
                self.held = block
            if not self.held:
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(path: str, folder: str) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """(header fields, full payload's length, the body's chunks) of each record of an archive."""
    files, _ = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(path, compression=None) as stream:
        source = _Source(inflated(stream))
        while (head := source.until(b"\r\n\r\n")) is not None:
            fields = _fields(head)
            http = source.until(b"\r\n\r\n")
            body = source.take(int(fields["content-length"]) - len(http) - 4)
            yield fields, int(_fields(http)["content-length"]), body
            for _ in body:  # whatever the caller left
                pass
            if b"".join(source.take(4)) != b"\r\n\r\n":
                raise ValueError("a record is longer than it says")


def read_warc_chunks(manifest: DataFrame, folder: str) -> DataFrame:
    """The archives as chunk rows (page_id, url, record_type, refers_to, chunk_no, last, chunk, bytes_so_far, digest_so_far); a record's last row has its whole length and
    digest, which are held against those that its header states. A revisit has one row without bytes, with what its header states."""

    def rows_of(path: str) -> Iterator[tuple]:
        for fields, length, body in read_records(path, folder):
            stated = fields["warc-payload-digest"].removeprefix("sha1:")
            refers = fields.get("warc-refers-to")
            about = (page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], page_of(refers) if refers else None)
            if fields["warc-type"] != "response":
                yield (*about, 0, True, None, length, stated)
                continue
            size, digest, n = 0, hashlib.sha1(), 0
            held = next(body, b"")
            while held is not None:
                size += len(held)
                digest.update(held)
                after = next(body, None)
                state = base32_sha1(digest.digest())
                if after is None and (size != length or state != stated):
                    raise ValueError(f"{path}: a payload does not have its digest")
                yield (*about, n, after is None, held, size, state)
                held, n = after, n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, size = arrow_schema(READ), [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows_of(path):
                    rows.append(row)
                    size += len(row[6] or b"")
                    if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return manifest.select("path").mapInArrow(run, READ)


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the archives' records, folded from their chunk rows."""
    return read_warc_chunks(manifest, folder).where("last").select(
        "page_id", "url", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared one, as a URI."""
    shared = shared_folder(spark)
    return f"{shared if ':' in shared else 'file://' + shared}/warc-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    return read_warc(write_warc(table(spark, sf_dir, "pages"), folder), folder).drop("url")


#: The same records, without the base-32 form of the digest, which SQL lacks a function for: it is built from the hexadecimal one.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, octet_length(b)) AS last FROM p),
bits AS (
  SELECT *, list_reduce(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), lambda a, b: a || b) AS s FROM d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(s, 5 * i::INT + 1, 1)::INT + 8 * substr(s, 5 * i::INT + 2, 1)::INT + 4 * substr(s, 5 * i::INT + 3, 1)::INT
      + 2 * substr(s, 5 * i::INT + 4, 1)::INT + substr(s, 5 * i::INT + 5, 1)::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM bits
"""
