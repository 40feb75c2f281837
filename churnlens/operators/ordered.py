"""Order-dependent primitives without a single-partition window.

A window with no PARTITION BY (``row_number() over (order by x)``) moves every row into one task.
These helpers compute the same results distributed:

* ``distributed_rank``  - row_number() over (partition by keys order by ...), 1-based.
* ``running_sum``       - inclusive cumulative sums over an order, per key.

Both range-partition the rows on (keys, order) - a hot key or a hot score is spread over many
range partitions, so skew does not concentrate work in one task - and tag every row with its
range partition. The tagged frame is materialised ONCE with a reliable ``checkpoint()`` in the
shared checkpoint folder: range bounds come from a sample seeded per RDD, so the per-partition
statistics and the rows must come from the same materialisation, and the checkpoint also cuts
lineage so a lost executor never recomputes a different split. Per-(partition, key) offsets are
a tiny aggregate (one row per partition and key) joined back; the row side never moves again.
Pass a total order (always include a unique tie-breaker) for deterministic results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import checkpoint_dir

_PID = "_cl_pid"
_POS = "_cl_pos"


def _n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _as_cols(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def _offset_join(df: DataFrame, small: DataFrame, on: list[str], keyed: bool) -> DataFrame:
    # Without keys the offset table has at most one row per range partition: a proven bound,
    # so it is broadcast explicitly. With keys its size depends on the key cardinality and the
    # choice is left to AQE, which sees the real size at run time.
    return df.join(F.broadcast(small) if not keyed else small, on)


def _tagged(df: DataFrame, order_cols: list[Column], keys: list[str], n: int, with_pos: bool) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    parted = df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
    if with_pos:
        parted = parted.sortWithinPartitions(*[F.col(k) for k in keys], *order_cols)
    tagged = parted.withColumn(_PID, F.spark_partition_id())
    if with_pos:
        tagged = tagged.withColumn(
            _POS, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    return tagged.checkpoint(eager=True)


def distributed_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    out: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Append ``out`` = 1-based row number within ``keys`` following ``order`` (must be total)."""
    keys = list(keys)
    n = num_partitions or _n_partitions(df)
    tagged = _tagged(df, _as_cols(order), keys, n, with_pos=True)
    per_part = tagged.groupBy(_PID, *keys).agg(F.min(_POS).alias("_cl_first"), F.count(F.lit(1)).alias("_cl_n"))
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(_PID, *keys, "_cl_first", F.coalesce(F.sum("_cl_n").over(w), F.lit(0)).alias("_cl_before"))
    ranked = _offset_join(tagged, offsets, [_PID, *keys], bool(keys))
    rank = (F.col(_POS) - F.col("_cl_first") + F.col("_cl_before") + 1).cast("bigint")
    return ranked.withColumn(out, rank).drop(_PID, _POS, "_cl_first", "_cl_before")


def running_sum(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: Sequence[str],
    keys: Sequence[str] = (),
    prefix: str = "cum_",
    num_partitions: int | None = None,
) -> DataFrame:
    """Append ``prefix + c`` = inclusive running sum of each column in ``sums`` (order must be total)."""
    keys = list(keys)
    n = num_partitions or _n_partitions(df)
    order_cols = _as_cols(order)
    tagged = _tagged(df, order_cols, keys, n, with_pos=False)
    per_part = tagged.groupBy(_PID, *keys).agg(*[F.sum(c).alias(f"_cl_t_{c}") for c in sums])
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        _PID, *keys, *[F.coalesce(F.sum(f"_cl_t_{c}").over(w), F.lit(0)).alias(f"_cl_o_{c}") for c in sums])
    joined = _offset_join(tagged, offsets, [_PID, *keys], bool(keys))
    # the window is partitioned by the range partition id: no task holds more than one range
    w2 = Window.partitionBy(_PID, *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for c in sums:
        out = out.withColumn(f"{prefix}{c}", F.sum(c).over(w2) + F.col(f"_cl_o_{c}"))
    return out.drop(_PID, *[f"_cl_o_{c}" for c in sums])
