"""Operator 10, token-id output: bit-plane shuffled binary shards.

A shard is one file that holds the token ids of a range of documents in ascending doc_id order:

    b"IDPLANE1" | chunk payloads | footer | footer length (8 bytes, little endian)

Ids are cut into chunks of ``CHUNK`` ids across document bounds. A chunk is transposed into planes
(4 byte planes or 32 bit planes) and each plane is one zstandard frame. The footer is zstandard
over: JSON sizes, the chunk index (offset, ids, bytes of every plane) and the document index
(doc_id, number of ids, whether the id is not null). So a reader can seek to any token by the index and skip the rest.

Documents are range-partitioned and sorted by doc_id on Spark, each task writes one shard to the
shared folder under a temporary name and renames it, so a task that runs twice leaves the same
file. Every shard streams: a task holds one batch of texts and one chunk.

Defined edge cases: null and empty texts hold only the end id; an empty table makes shards without
documents or none; rows that repeat a doc_id follow one another, ordered by their text's hash; null ids come first.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored
from churnlens.session import scratch_path

MAGIC = b"IDPLANE1"
CHUNK = 1 << 16
END_ID = 1
#: words whose ids a Python worker remembers
CACHE_WORDS = 500_000


def to_planes(ids: np.ndarray, mode: str) -> np.ndarray:
    """The planes of a chunk, one a row: all lowest bytes (or bits), then the next ones."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(len(ids), 4)
    if mode == "byte":
        return np.ascontiguousarray(raw.T)
    return np.ascontiguousarray(np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little"))


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if mode == "byte":
        return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, out, mode: str = "byte", level: int = 1) -> None:
        self.out, self.mode, self.zstd = out, mode, zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.at, self.held, self.rest = len(MAGIC), [], 0
        self.chunks: list[list[int]] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, valid: np.ndarray | None = None) -> None:
        """Documents with their number of ids, and all their ids one after another; ``valid`` is false for a null doc_id."""
        valid = np.ones(len(doc_ids), bool) if valid is None else valid
        self.docs.append(np.stack((doc_ids.astype("<i8"), counts.astype("<i8"), valid.astype("<i8"))))
        self.held.append(ids)
        self.rest += len(ids)
        if self.rest >= CHUNK:
            ids = np.concatenate(self.held)
            whole = len(ids) // CHUNK * CHUNK
            for k in range(0, whole, CHUNK):
                self._chunk(ids[k:k + CHUNK])
            self.held, self.rest = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.zstd.compress(p) for p in to_planes(ids, self.mode)]
        self.chunks.append([self.at, len(ids), *map(len, frames)])
        for f in frames:
            self.out.write(f)
            self.at += len(f)

    def close(self) -> tuple[int, int]:
        if self.rest:
            self._chunk(np.concatenate(self.held))
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.zeros((3, 0), "<i8")
        index = np.array(self.chunks, "<i8")
        head = json.dumps({"mode": self.mode, "docs": docs.shape[1], "chunks": len(self.chunks), "ids": int(docs[1].sum())}).encode()
        footer = self.zstd.compress(len(head).to_bytes(4, "little") + head + index.tobytes() + docs.tobytes())
        self.out.write(footer + len(footer).to_bytes(8, "little"))
        return docs.shape[1], int(docs[1].sum())


class ShardReader:
    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        file.seek(size - 8)
        length = int.from_bytes(file.read(8), "little")
        file.seek(size - 8 - length)
        raw = zstandard.ZstdDecompressor().decompress(file.read(length))
        n = int.from_bytes(raw[:4], "little")
        self.head = json.loads(raw[4:4 + n])
        width = 2 + (4 if self.head["mode"] == "byte" else 32)
        numbers = np.frombuffer(raw[4 + n:], "<i8")
        cut = self.head["chunks"] * width
        self.index = numbers[:cut].reshape(-1, width)
        self.doc_ids, self.counts, valid = numbers[cut:].reshape(3, -1)
        self.valid = valid.astype(bool)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        self.file.seek(at)
        zstd = zstandard.ZstdDecompressor()
        return from_planes([zstd.decompress(self.file.read(s)) for s in sizes], n, self.head["mode"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop of the shard, from the chunks that hold them."""
        first, last = start // CHUNK, -(-stop // CHUNK)
        got = [self.chunk(k) for k in range(first, last)]
        return np.concatenate(got)[start - first * CHUNK:stop - first * CHUNK] if got else np.zeros(0, "<u4")

    def checksums(self) -> np.ndarray:
        """crc32 of the ids of each document, chunk by chunk."""
        bounds = np.concatenate(([0], np.cumsum(self.counts)))
        out = np.zeros(len(self.counts), dtype=np.int64)
        for k in range(len(self.index)):
            ids = self.chunk(k)
            base = k * CHUNK
            raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
            i, j = np.searchsorted(bounds, base, "right") - 1, np.searchsorted(bounds, base + len(ids), "left")
            for d in range(i, j):
                a, b = max(bounds[d], base) - base, min(bounds[d + 1], base + len(ids)) - base
                out[d] = zlib.crc32(raw[4 * a:4 * b], int(out[d]))
        return out


class WordEncoder(dict):
    """Ids of texts under a byte-level BPE that splits texts into runs of letters, single numbers and
    runs of other signs, drops white space and lower-cases. Nothing is joined across white space, so
    a text's ids are those of its blank-separated words; the dict holds the words met so far. A plain
    Latin word goes straight to the library's model, any other word through its whole pipeline."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cores: dict[str, bytes] = {}

    def _core(self, core: str) -> bytes:
        got = self.cores.get(core)
        if got is None:
            if len(self.cores) >= CACHE_WORDS:
                self.cores.clear()
            raw = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_SIGNS)
            ids = [t.id for t in self.model.tokenize(raw)]
            got = self.cores[core] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if core.isalpha() and max(core) <= "\xff":
            got = self._core(core.lower())
            if core != word:
                got += self[word[len(core):]]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        words = text.translate(_BLANKS).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


#: the blanks that texts are cut at; each is white space to the tokenizer as well
_BLANKS = {9: " ", 10: " ", 13: " "}
#: signs that, after a letter, are a token run of their own
_TAIL = ".,;:!?*#$%&|"
#: byte-level alphabets show bytes that don't print as the code points from 256 on
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
_encoders: dict[str, WordEncoder] = {}


def _write_map(folder: str, vocabulary: str, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if vocabulary not in _encoders:
            _encoders[vocabulary] = WordEncoder(vocabulary)
        encoder = _encoders[vocabulary]
        shard = TaskContext.get().partitionId()
        fs, path = pafs.FileSystem.from_uri(f"{folder}/shard-{shard:06d}.ids")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        end = np.array([END_ID], "<u4").tobytes()
        with fs.open_output_stream(part) as out:
            writer = ShardWriter(out, mode)
            for batch in batches:
                for rows, _, _ in tk.slices(batch, "text"):
                    got = [encoder.encode(t) + end if t else end for t in rows.column(1).to_pylist()]
                    counts = np.array([len(x) // 4 for x in got])
                    doc_ids = rows.column(0)
                    writer.add(doc_ids.fill_null(0).to_numpy(), counts, np.frombuffer(b"".join(got), "<u4"), doc_ids.is_valid().to_numpy(zero_copy_only=False))
            docs, ids = writer.close()
        fs.move(part, path)
        yield tk.record_batch(shard=pa.array([shard], pa.int64()), docs=[docs], ids=[ids])
    return run


def _read_map(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, docs, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = pafs.FileSystem.from_uri(f"{folder}/shard-{shard:06d}.ids")
                with fs.open_input_file(path) as file:
                    reader = ShardReader(file, file.size())
                    if reader.head["docs"] != docs:
                        raise ValueError(f"{path} holds {reader.head['docs']} documents, not {docs}")
                    sums = reader.checksums()
                starts = start + np.concatenate(([0], np.cumsum(reader.counts)))[:-1]
                for k in range(0, docs, 20_000):
                    at = slice(k, k + 20_000)
                    yield tk.record_batch(doc_id=pa.array(reader.doc_ids[at], mask=~reader.valid[at]), start=starts[at], n_tokens=reader.counts[at], ids_crc32=sums[at])
    return run


def write_shards(docs: DataFrame, folder: str, vocabulary: str, mode: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; returns (shard, docs, ids, start): start is the ids of all shards before."""
    spark = docs.sparkSession
    d = tk.texts(docs, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    dealt = d.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    written = stored(tk.map_batches(dealt, _write_map(folder, vocabulary, mode), "shard long, docs long, ids long"), "shards")
    # one row a shard, so one task may order them
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files; a task reads one shard at a time."""
    n = int(shards.agg(F.max("shard")).first()[0] or 0) + 1
    each = spark.range(0, n, 1, n).withColumnRenamed("id", "shard")
    return each.join(F.broadcast(shards), "shard").select("shard", "docs", "start").mapInArrow(
        _read_map(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, mode: str = "byte") -> DataFrame:
    """Write ``docs`` as shards into the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, vocabulary, mode))
