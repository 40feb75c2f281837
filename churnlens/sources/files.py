"""Sources and sinks: raw CSV scan, content fingerprints, deterministic CSV/JSON/Parquet writers,
model version ids and the provenance record.

Table fingerprints are order-independent sums of per-row hashes, so a partitioned table has one id
whatever its file layout, and the hash is one aggregate (partial sums per task, no shuffle of rows).
A file's SHA-256 is by nature one chain over its bytes: Spark reads its blocks in parallel and one task
a file takes the lines in order, holding one line at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.exprs import canonical
from churnlens.session import scratch_path

# Hyper-parameters of the shipped logistic model, as recorded in its version payload.
LR_PARAMS = {"C": 1.0, "max_iter": 1000, "penalty": "l2", "solver": "lbfgs"}
LR_PARAMS_JSON = json.dumps(LR_PARAMS, sort_keys=True)


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every field as text; blanks like ' ' survive; an empty field becomes '' (never NULL)."""
    df = (spark.read.option("header", True).option("escape", '"').option("inferSchema", False)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("encoding", "UTF-8").csv(path))
    return df.na.fill("")


def write_csv(df: DataFrame, path: str, single_file: bool = False, order_by: Sequence[str] | None = None) -> str:
    """Header, LF line ends, UTF-8, whitespace kept. ``single_file`` + ``order_by`` give stable bytes
    (only for bounded outputs: a single file is written by one task)."""
    out = df
    if order_by:
        out = out.orderBy(*order_by)
    if single_file:
        out = out.coalesce(1)
    (out.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", "UTF-8").csv(path))
    return path


def write_json(df: DataFrame, path: str, single_file: bool = False) -> str:
    """JSON lines with the keys in alphabetical order at every depth, nulls written out."""
    out = df.select(*[canonical(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(df.columns)])
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("lineSep", "\n").option("ignoreNullFields", "false").json(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


_BOM = b"\xef\xbb\xbf"


class _LineDigest:
    """SHA-256 of a file given line by line without line ends, CRLF taken as LF.

    A line's end is known once another follows; that of the last one, and a byte order mark, which
    the reader drops, show in the file's size."""

    def __init__(self, size: int) -> None:
        self.size, self.seen, self.held = size, 0, None
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(_BOM)

    def _take(self, data: bytes) -> None:
        self.plain.update(data)
        self.marked.update(data)

    def line(self, data: bytes) -> None:
        if self.held is not None:
            self._take(self.held.removesuffix(b"\r") + b"\n")
        self.held = data
        self.seen += len(data) + 1

    def hex(self) -> str:
        more = self.size - self.seen
        if more not in (-1, 0, len(_BOM) - 1, len(_BOM)):
            raise ValueError(f"{self.size} bytes on disk, {self.seen} in lines: compressed files have no such fingerprint")
        ended = more in (0, len(_BOM))
        self._take(self.held.removesuffix(b"\r") + b"\n" if ended else self.held)
        return (self.marked if more > 0 else self.plain).hexdigest()


def _digest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, size, line) in file order within a task -> (path, sha256_lf_normalised)."""
    at, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hex()])], names=["path", "sha256_lf_normalised"])

    for batch in batches:
        paths, sizes = batch.column("path").to_pylist(), batch.column("size").to_pylist()
        for path, size, line in zip(paths, sizes, batch.column("line"), strict=True):
            if path != at:
                if digest is not None:
                    yield done()
                at, digest = path, _LineDigest(size)
            digest.line(line.as_py())
    if digest is not None:
        yield done()


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256_lf_normalised): SHA-256 of each file's bytes with CRLF as LF, whatever its encoding.

    No cell or task holds a file: the text reader splits it in blocks, and the lines go by path and place
    to the one task that chains the digest. A line too long for a cell fails; an empty file has no row, as
    Spark's readers don't list it."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))
    ordered = lines.repartition("path").sortWithinPartitions("path", "block", "place").select("path", "size", "line")
    return ordered.mapInArrow(_digest_files, "path string, sha256_lf_normalised string")


def table_fingerprint(df: DataFrame, columns: Sequence[str], algo: str = "sha256") -> DataFrame:
    """n_rows and an order-independent content hash (sum of 60-bit row-hash prefixes, as text)."""
    row = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = F.md5(row) if algo == "md5" else F.sha2(row, 256)
    part = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum(part).cast("string").alias("fingerprint"))


SHORT_NAMES = {"logistic_regression": "lr", "random_forest": "rf", "gradient_boosting": "gbt", "prior_baseline": "prior"}


def model_version(dataset: DataFrame, model_name: str, feature_fingerprint: str, params_json: str = LR_PARAMS_JSON,
                  seed: int = 42, scope: str = "final refit on all rows") -> DataFrame:
    """Content-derived id from a one-row frame holding the dataset fingerprint (column ``dataset``).
    The payload is the sorted-key JSON of dataset, features, model, params, scope and seed."""
    payload = F.concat(
        F.lit('{"dataset": "'), F.col("dataset"),
        F.lit(f'", "features": "{feature_fingerprint}", "model": "{model_name}", "params": {params_json}, '
              f'"scope": "{scope}", "seed": {seed}}}'),
    )
    short = SHORT_NAMES.get(model_name, model_name)
    return dataset.select(F.concat(F.lit(f"churn-{short}-"), F.substring(F.sha2(payload, 256), 1, 10)).alias("model_version"))
