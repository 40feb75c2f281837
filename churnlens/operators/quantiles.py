"""Exact quantiles by distributed selection.

A percentile aggregate buffers every distinct value in one task. Here a quantile is a rank, and a rank is
found by narrowing an interval of values: each round counts the rows in ``bins`` equal parts of every open
interval (partial aggregation, a few hundred rows a key), keeps the part that holds the rank and goes on
between that part's least and greatest value. An interval of one value is the answer. A part always
leaves out the least or the greatest value, so the rounds end; they need about log(range) / log(bins). The
source is read once: the values alone are stored, and after the first round only those inside open intervals.

Interpolation is linear between neighbouring ranks. Null and NaN are left out; a key without values has nulls.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.session import stored


def exact_quantiles(long: DataFrame, probs: Sequence[float], key: str = "column", value: str = "value", bins: int = 256) -> dict[str, list[float | None]]:
    """{key: quantiles at ``probs``}; for a few keys (columns, segments), each of any number of rows."""
    base = stored(long.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"), "quantile-values")
    size = {r.k: r for r in base.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    place = {(k, p): p * (r.n - 1) for k, r in size.items() for p in probs}
    open_ = {(k, rank): (size[k].lo, size[k].hi, 0) for (k, _), x in place.items() for rank in (math.floor(x), math.ceil(x))}
    found: dict[tuple[str, int], float] = {}
    turn = 0
    while True:
        found |= {at: lo for at, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {at: span for at, span in open_.items() if span[0] < span[1]}
        if not open_:
            break
        spans = long.sparkSession.createDataFrame(sorted({(k, lo, hi) for (k, _), (lo, hi, _) in open_.items()}), "k string, lo double, hi double")
        inside = base.join(F.broadcast(spans), "k").where("v >= lo and v <= hi")
        # halves, as the difference of two doubles can pass the largest one; the ends are placed by hand, as
        # half of the smallest doubles is 0
        half = F.floor(F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2) * bins)
        part = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.least(F.coalesce(half, F.lit(0)), F.lit(bins - 1)))
        counts: dict[tuple, list] = {}
        for r in inside.groupBy("k", "lo", "hi", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("part").collect():
            counts.setdefault((r.k, r.lo, r.hi), []).append(r)
        for (k, rank), (lo, hi, below) in open_.items():
            for r in counts[k, lo, hi]:
                if rank < below + r.n:
                    open_[k, rank] = (r.least, r.most, below)
                    break
                below += r.n
        turn += 1
        if turn == 1:  # parts of one round do not overlap, so no row is kept twice
            left = sorted({(k, lo, hi) for (k, _), (lo, hi, _) in open_.items() if lo < hi})
            if left:
                keep = long.sparkSession.createDataFrame(left, "k string, lo double, hi double")
                base = stored(base.join(F.broadcast(keep), "k").where("v >= lo and v <= hi").select("k", "v"), "quantile-rows")
    out: dict[str, list[float | None]] = {}
    for k in size:
        row = []
        for p in probs:
            x = place[k, p]
            a, b = found[k, math.floor(x)], found[k, math.ceil(x)]
            row.append(a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b)
        out[k] = row
    return out

