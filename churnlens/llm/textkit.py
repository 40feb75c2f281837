"""Vectorised text kernels shared by the operators that run numpy inside Spark tasks.

Everything works on the UTF-8 bytes of one Arrow batch: word bounds come from a 256-entry byte
table, word hashes from a prefix sum, so no Python loop runs per word or per character. Words are
identified by 64-bit hashes; two different words share one with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_PIECE = 1 << 20
_STEP = U64(0x9E3779B97F4A7C15)
_A, _B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: bytes of `[^\x20\x09-\x0D]+`
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _A
        x = (x ^ (x >> U64(27))) * _B
        return x ^ (x >> U64(31))


_BYTE = mix((np.arange(256, dtype=U64) + U64(1)) * _STEP)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _PIECE)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, U64(base), dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def batch_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the n + 1 row bounds) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a row bound."""
    n = len(mask)
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = mask[:-1]
    after[-1:] = False
    after[:-1] = mask[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint spans, in pieces of bounded memory."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            s = starts[i]
            j = max(int(np.searchsorted(ends, s + _PIECE, "right")), i + 1)
            up, down = _power_tables(int(ends[j - 1] - s) + 1)
            sums = np.zeros(int(ends[j - 1] - s) + 1, dtype=U64)
            np.cumsum(_BYTE[buf[s:ends[j - 1]]] * up[:len(sums) - 1], out=sums[1:])
            a, b = starts[i:j] - s, ends[i:j] - s
            out[i:j] = (sums[b] - sums[a]) * down[a]
            i = j
        return mix(out + (ends - starts).astype(U64) * _STEP)


def hash_words(words: list[str]) -> np.ndarray:
    """The same hash of single words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if raw else ends
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


class Words:
    """The words of a batch of rows: hashes, byte spans, and the range of words of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool) -> None:
        self.buf = LOWER[buf] if lower else buf
        self.offs = offs
        self.starts, self.ends = runs(table[self.buf], offs)
        self.hash = hash_spans(self.buf, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes (empty if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        acc = np.full(m, U64(n), dtype=U64)
        for k in range(n):
            acc = acc * _A + h[k:k + m]
        return mix(acc)


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch whose texts hold about ``size`` bytes (one row at least), with their bytes."""
    buf, offs = batch_bytes(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(int(np.searchsorted(offs, offs[i] + size, "right")) - 1, i + 1)
        yield batch.slice(i, j - i), buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches that stay small when texts are long."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the operators read, under fixed names; other columns can't clash."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
