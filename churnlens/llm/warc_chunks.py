"""Operator 12, WARC archives through a chunked record table.

1. ``chunk_table``: every payload is streamed as rows (uid, chunk, data) of at most ``CHUNK`` bytes,
   cut from the Arrow buffer without a copy of the whole record. Each row carries the SHA-256 of the
   payload up to and with it, from one running hash; the last row's is the payload digest.
2. ``record_table``: of records with equal payloads of ``REVISIT_BYTES`` or more, the one of the least
   page_id is the response and the others revisit it. Only digests move, never payloads; the least
   one of a digest is a partial aggregate, so a payload that a third of all pages share is no hot task.
3. ``write_archives``: the records, a short row each, are dealt by the chunk file that holds them; a
   task streams that file from the shared folder beside them, so payloads are never shuffled. Each chunk
   file becomes one archive, ``.warc.gz`` with one gzip member a record: the header, then chunk by
   chunk, checking each running digest. A task holds a few chunks at a time. An archive gets its name
   when it is whole, so a task that runs twice leaves the same file.
4. ``read_archives``: each archive is inflated member by member in pieces of ``CHUNK`` bytes; the payload
   is hashed as it passes and held against the record's header. A revisit has no payload; its size
   comes from the response that it refers to.

Defined edge cases: a null html is an empty payload; a null or empty url leaves out WARC-Target-URI and
its control signs are percent-encoded; records with a null page_id are written, come after all others
when the least page_id is sought, and keep their null; rows that repeat a page_id are records of their
own, and of two equal ones the first uid is the response; an empty table gives archives without
records or none and no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored
from churnlens.session import scratch_path

CHUNK = 256 << 10
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = "uid long, page_id long, url string, chunk int, data binary, bytes long, digest string, last boolean"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _chunk_map(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, buf, offs in tk.slices(batch, "html"):
                raw, bounds = memoryview(buf), offs.tolist()
                out: list[tuple] = []
                held = 0
                for i, (page, url) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                    digest, a, b = hashlib.sha256(), bounds[i], bounds[i + 1]
                    for k, at in enumerate(range(a, max(b, a + 1), size)):
                        piece = raw[at:min(at + size, b)]
                        digest.update(piece)
                        last = at + size >= b
                        out.append((uid, page, url if k == 0 else None, k, bytes(piece), min(at + size, b) - a, digest.copy().hexdigest(), last))
                        held += len(piece)
                        if held >= 4 * size:
                            yield _chunk_batch(out)
                            out, held = [], 0
                    uid += 1
                if out:
                    yield _chunk_batch(out)
    return run


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", size: int = CHUNK) -> DataFrame:
    """(uid, page_id, url, chunk, data, bytes, digest, last); bytes and digest are of the payload so far.
    The table is stored, so that the uids stay what they are."""
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    path = scratch_path(pages.sparkSession, "chunks")
    # small row groups, as a reader holds one; a partition's rows keep their order in its file
    tk.map_batches(d, _chunk_map(size), _CHUNKS).write.option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(_CHUNKS).parquet(path)


def record_table(chunks: DataFrame) -> DataFrame:
    """(file, uid, page_id, payload_bytes, payload_digest, record_type, response_uid, refers_to); file is
    the chunk file that holds the record."""
    records = chunks.where("last").select(F.col("_metadata.file_path").alias("file"), "uid", "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    first = records.where(f"payload_bytes >= {REVISIT_BYTES}").groupBy("payload_digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        "payload_digest", F.col("first.uid").alias("first_uid"), F.col("first.page_id").alias("first_page"))
    revisit = F.coalesce(F.col("uid") != F.col("first_uid"), F.lit(False))
    return records.join(first, "payload_digest", "left").select(
        "file", "uid", "page_id", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_uid")).alias("response_uid"), F.when(revisit, F.col("first_page")).alias("refers_to"))


def _urn(uid: int, page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{uid}>"


def _from_urn(urn: str) -> tuple[int, int | None]:
    page, uid = urn[len("<urn:x-page:"):-1].split(":")
    return int(uid), int(page) if page else None


def _safe_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _head(uid, page, url, size, digest, kind, response, refers) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = _HTTP.format(size).encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(uid, page)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {_safe_url(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(response, refers)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


class ArchiveWriter:
    """Records go in as a head and chunks; each is a gzip member of its own."""

    def __init__(self, out) -> None:
        self.out, self.member, self.records, self.at = out, None, 0, 0

    def _put(self, data: bytes) -> None:
        self._raw(self.member.compress(data))

    def _raw(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)

    def open(self, uid, page, url, size, digest, kind, response, refers) -> None:
        self.close()
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        warc, http = _head(uid, page, url, size, digest, kind, response, refers)
        self._put(warc + http)
        self.kind, self.left, self.digest, self.hash, self.uid = kind, size, digest, hashlib.sha256(), uid
        self.records += 1

    def chunk(self, uid: int, data: bytes, digest: str) -> None:
        if uid != self.uid:
            raise ValueError(f"chunk of record {uid} after the head of {self.uid}")
        if self.kind == "response":
            self.hash.update(data)
            if self.hash.copy().hexdigest() != digest:
                raise ValueError(f"record {uid}: a chunk is missing or changed")
            self.left -= len(data)
            self._put(data)

    def close(self) -> None:
        if self.member is not None:
            if self.kind == "response" and (self.left or self.hash.hexdigest() != self.digest):
                raise ValueError(f"record {self.uid} is not whole")
            self._put(b"\r\n\r\n")
            self._raw(self.member.flush())
            self.member = None


def read_records(file, piece: int = CHUNK) -> Iterator[tuple]:
    """(uid, page_id, payload bytes, payload digest, type, response uid, refers_to) of the records of an
    open archive; holds one piece of compressed and one of plain bytes."""
    raw, done = b"", False
    while True:
        member, buf, head, left, size, digest = zlib.decompressobj(31), b"", None, 0, 0, hashlib.sha256()
        started = False
        while not member.eof:
            if not raw and not done:
                raw = file.read(piece)
                done = not raw
            if not raw and done:
                if started:
                    raise ValueError("the archive ends within a record")
                return
            started = True
            plain = member.decompress(raw, piece)
            raw = member.unconsumed_tail or member.unused_data
            if head is None:
                buf += plain
                end = buf.find(b"\r\n\r\n")
                stop = buf.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
                if stop < 0:
                    continue
                head = dict(x.split(": ", 1) for x in buf[:end].decode().split("\r\n")[1:])
                left = int(head["Content-Length"]) - (stop - end)
                plain = buf[stop + 4:]
            body = plain[:left]
            digest.update(body)
            size += len(body)
            left -= len(body)
        if head is None or left:
            raise ValueError("a record is not whole")
        uid, page = _from_urn(head["WARC-Record-ID"])
        named = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "revisit":
            yield uid, page, None, named, "revisit", *_from_urn(head["WARC-Refers-To"])
        else:
            if digest.hexdigest() != named:
                raise ValueError(f"record {uid}: the payload is not what its header says")
            yield uid, page, size, named, "response", None, None


def _chunk_rows(url: str) -> Iterator[tuple]:
    """(uid, url, chunk, data, digest) of a chunk file, in its order."""
    fs, path = pafs.FileSystem.from_uri(url)
    with fs.open_input_file(path) as file:
        reader = pq.ParquetFile(file, pre_buffer=False, buffer_size=1 << 20)
        for batch in reader.iter_batches(batch_size=64, columns=["uid", "url", "chunk", "data", "digest"], use_threads=False):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _write_map(folder: str):
    def archive(url: str, records: Iterator[tuple]) -> tuple[str, int, int]:
        name = url.rpartition("/")[2].partition(".")[0] + ".warc.gz"
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            writer = ArchiveWriter(out)
            for uid, target, chunk, data, digest in _chunk_rows(url):
                if chunk == 0:
                    head = next(records)
                    if head[0] != uid:
                        raise ValueError(f"record {uid} has no head")
                    writer.open(uid, head[1], target, *head[2:])
                writer.chunk(uid, data, digest)
            writer.close()
        if next(records, None) is not None:
            raise ValueError(f"{url} ends before its records")
        fs.move(draft, path)
        return name, writer.records, writer.at

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for url, records in itertools.groupby(rows(batches), key=lambda r: r[0]):
            name, n, size = archive(url, (r[1:] for r in records))
            yield tk.record_batch(archive=[name], records=pa.array([n], pa.int64()), bytes=pa.array([size], pa.int64()))
    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the archives into ``folder``; returns (archive, records, bytes)."""
    heads = records.select("file", "uid", "page_id", "payload_bytes", "payload_digest", "record_type", "response_uid", "refers_to")
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.repartition(parts, "file").sortWithinPartitions("file", "uid")
    return stored(tk.map_batches(dealt, _write_map(folder), "archive string, records long, bytes long"), "archives")


def _read_map(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = ["uid", "page_id", "payload_bytes", "payload_digest", "record_type", "response_uid", "refers_to"]
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(f"{folder}/{archive}")
                out: list[tuple] = []
                seen = 0
                with fs.open_input_stream(path, compression=None) as file:
                    for row in read_records(file):
                        out.append(row)
                        seen += 1
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out = []
                if seen != records:
                    raise ValueError(f"{archive} holds {seen} records, not {records}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    return run


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives."""
    n = max(int(archives.count()), 1)
    each = archives.select("archive", "records").repartition(n, "archive")
    found = stored(tk.map_batches(each, _read_map(folder), "uid long, page_id long, payload_bytes long, payload_digest string, record_type string, response_uid long, refers_to long"), "records")
    responses = found.where("record_type = 'response'").select(F.col("uid").alias("response_uid"), F.col("payload_bytes").alias("response_bytes"), F.col("payload_digest").alias("response_digest"))
    revisits = found.where("record_type = 'revisit'").join(responses, "response_uid", "left").withColumn(
        "payload_bytes", F.when(F.col("response_digest") == F.col("payload_digest"), F.col("response_bytes")).otherwise(F.raise_error(F.lit("a revisit refers to no response with its digest")).cast("long")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    chunks = chunk_table(pages)
    return read_archives(spark, folder, write_archives(stored(record_table(chunks), "record-table"), folder))
