"""WARC archives: a writer with one gzip member for each record, and a reader whose tasks take byte ranges of the files.

A reading task scans its range for the gzip magic, takes a candidate for a record only if its first bytes inflate to a WARC header, and then follows
the members one by one. It owns the records that start inside its range and reads the last of them beyond the range's end, so that ranges need
no index and no agreement. Files are reached through pyarrow's file systems, which cover local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import set_apart, shared_dir, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 20
_BATCH_BYTES = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(key.encode()).hexdigest())}>"


def _field(value: str) -> str:
    """A header's value: signs that would end the line are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(f'{page_id}|{digest}')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(f'{refers_to}|{digest}')}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode()) + squeeze.compress(body) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, where, n = None, "", 0
        try:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        # A name of its own for each attempt: what a lost task has left is in no manifest, so nobody reads it.
                        where = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        system, path = _open(where)
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(path, compression=None)
                    out.write(record_bytes("response" if refers_to is None else "revisit", page_id, url, (html or "").encode(), digest, refers_to, date))
                    n += 1
            size = out.tell() if out else 0
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row and returns the manifest (path, bytes, records): the files that hold the rows, each row once.

    The payload is the html in UTF-8; null is empty. Among rows with equal payloads of at least `least` bytes, those with the smallest id are responses,
    and the others, those without an id included, are revisits that refer to it and hold no payload; where no row has an id, all are responses.
    Rows that repeat a response's id and payload are responses too. An empty table gives an empty manifest. Other columns are not written.

    Only ids and digests are grouped, with map-side combining; the payloads then move once, in a join that the adaptive planner can split where
    a third of all rows has one payload.
    """
    folder = folder or shared_dir(pages.sparkSession)
    slim = set_apart(pages, (id_col, url_col, html_col), pages.columns)[0].toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint"))
    slim = slim.withColumn("digest", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))
    large = slim.where(F.octet_length("html") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("of"), "first")
    named = slim.join(first, F.col("digest") == F.col("of"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = named.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", refers.alias("refers_to"))
    return written(rows.mapInArrow(_write(folder, date), "path string, bytes bigint, records bigint"))


def _head(piece: bytes) -> dict[str, str] | None:
    """The fields of a WARC header at the start of piece, or None."""
    if not piece.startswith(b"WARC/1."):
        return None
    head, end, _ = piece.partition(b"\r\n\r\n")
    if not end:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if "warc-type" in fields else None


class _Source:
    """A file read forward in blocks, from which bytes can be taken at any place at or behind the last."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.file, self.held, self.at = system.open_input_file(name), b"", 0
        self.size = self.file.size()

    def piece(self, at: int, n: int) -> bytes:
        """n bytes from `at` on, fewer at the file's end."""
        if not self.at <= at or at + n > self.at + len(self.held) and self.at + len(self.held) < self.size:
            self.file.seek(at)
            self.held, self.at = self.file.read(max(n, _BLOCK)), at
        return self.held[at - self.at : at - self.at + n]


def _looks_valid(source: _Source, at: int) -> bool:
    """A candidate inflates to a WARC header, however long."""
    inflate, got, where = zlib.decompressobj(31), bytearray(), at
    while True:
        piece = source.piece(where, 4096)
        if not piece:
            return False
        try:
            new = inflate.decompress(piece)
        except zlib.error:
            return False
        # The end may begin in what came before.
        seen = max(len(got) - 3, 0)
        got += new
        where += len(piece)
        if not b"WARC/1.".startswith(got[:7]):
            return False
        if got.find(b"\r\n\r\n", seen) >= 0 or inflate.eof:
            return _head(bytes(got)) is not None


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The member's content and where it ends; None if it is damaged or cut."""
    inflate, out = zlib.decompressobj(31), []
    where = at
    while not inflate.eof:
        piece = source.piece(where, 1 << 15)
        if not piece:
            return None
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            return None
        where += len(piece)
    return b"".join(out), where - len(inflate.unused_data)


def records_in(path: str, begin: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records that start in [begin, end) of a file. Damaged or cut members are passed over; what follows is found again
    by its magic."""
    source, at = _Source(path), begin
    end = min(end, source.size)
    while at < end:
        if source.piece(at, 3) != MAGIC or not _looks_valid(source, at):
            area = source.piece(at + 1, 1 << 16)
            found = area.find(MAGIC)
            # Two bytes are looked at again, as the magic may be cut by the block's end.
            at = at + 1 + found if found >= 0 else at + 1 + max(len(area) - 2, 0) if at + 1 + len(area) < source.size else source.size
            continue
        member = _member(source, at)
        content = member[0] if member else b""
        fields = _head(content)
        if member is None or fields is None:
            at += 1
            continue
        body = content.index(b"\r\n\r\n") + 4
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else len(content) - body - 4
        yield at, fields, content[body : body + size]
        at = member[1]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The entity without the HTTP header."""
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


_READ = "path string, offset bigint, warc_type string, record_id string, refers_to_record string, target_uri string, declared_digest string, page_id bigint, refers_to bigint, payload binary"
_READ_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
_READ_NAMES = [x.split()[0] for x in _READ.split(", ")]


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _READ_TYPES)], names=_READ_NAMES)

    for ranges in batches:
        for path, begin, end in zip(*(c.to_pylist() for c in ranges.columns)):
            for offset, f, block in records_in(path, begin, end):
                payload = payload_of(f, block)
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                rows.append((path, offset, f["warc-type"], f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), digest, _number(f.get("x-page-id")), _number(f.get("x-refers-to-page-id")), payload))
                size += len(payload) + 500
                if size > _BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
    if rows:
        yield batch()


def read_archives(files: DataFrame, split_bytes: int = 32 << 20, least_splits: int = 1) -> DataFrame:
    """The records of the files named in files (path, bytes), with their payloads; a revisit has an empty one. No file at all gives no rows.

    Ranges are of split_bytes, or smaller if that gives fewer than least_splits of them; each is a task's unit, whatever the files' sizes. A file that is
    listed twice is read twice. Damaged and cut members give no row, and what stands behind them is found again; headers may have any length. Records come
    as they are: one without a page's id has null there.
    """
    total = files.agg(F.sum("bytes").alias("n"), F.count("*").alias("files")).first()
    if least_splits > 1 and total["n"]:
        split_bytes = max(1 << 16, min(split_bytes, -(-total["n"] // least_splits)))
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("begin"))
    ranges = ranges.select("path", F.col("begin").cast("bigint").alias("begin"), (F.col("begin") + F.lit(split_bytes)).cast("bigint").alias("end"))
    tasks = max(1, -(-(total["n"] or 0) // split_bytes) + (total["files"] or 0))
    return ranges.repartition(min(tasks, 100_000)).mapInArrow(_read, _READ)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives below a folder, for read_archives()."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes archives of pages and reads them back: page_id, payload_bytes, payload_digest, record_type and refers_to, and target_uri and declared_digest,
    one row for each row of pages.

    Digests and lengths are those of the payloads as read; a revisit has its response's, joined by the page it refers to. Null ids, urls and payloads, repeated
    rows, ties and empty tables are as write_archives() says; other columns of pages don't matter. It fails if other than all records are read back.
    """
    manifest = write_archives(pages, least=least)
    lanes = pages.sparkSession.sparkContext.defaultParallelism
    read = read_archives(manifest, least_splits=2 * lanes)
    read = read.select("page_id", F.octet_length("payload").cast("bigint").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest"), F.col("warc_type").alias("record_type"), "refers_to", "target_uri", "declared_digest")
    read = written(read)
    wrote, found = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"], read.count()
    if wrote != found:
        raise RuntimeError(f"{wrote} records were written and {found} read back")
    revisited = read.where("record_type = 'response'").join(read.where("refers_to is not null").groupBy(F.col("refers_to").alias("page_id"), F.col("declared_digest").alias("own_digest")).agg(F.count("*").alias("n")), ["page_id", "own_digest"])
    revisited = revisited.groupBy("page_id", "own_digest").agg(F.max("own_bytes").alias("bytes"), F.max("own_digest").alias("digest")).select(F.col("page_id").alias("of"), F.col("own_digest").alias("of_digest"), "bytes", "digest")
    joined = read.join(revisited, (F.col("refers_to") == F.col("of")) & (F.col("declared_digest") == F.col("of_digest")), "left")
    again = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", F.when(again, F.col("bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(again, F.col("digest")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to", "target_uri", "declared_digest")
