"""Exploratory profiling: shape, describe, null / distinct / value counts, cross tabs, shares,
equal-width histograms, kernel density on a grid, segment churn rates and medians.

Every profile is one aggregate (or an unpivot + aggregate) over the table; nothing is collected
except where the caller needs a scalar for the next step (min/max for histogram edges, bandwidth
for the density), which are single-row aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)
TENURE_BANDS = ((0, 6, "0-6"), (7, 12, "7-12"), (13, 24, "13-24"), (25, 48, "25-48"), (49, 72, "49-72"), (73, 2_147_483_647, "73+"))
SEGMENT_DIMENSIONS = ("contract", "internet_service", "payment_method", "tenure_band", "senior_citizen", "gender",
                      "tech_support")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def _unpivot(df: DataFrame, columns: Sequence[str], value_type: str = "string") -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value")) for c in columns])
    return df.select(F.inline(arr))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max per numeric column."""
    long = _unpivot(df, columns, "double")
    found = exact_quantiles(long, QUARTILES)
    rows = [(c, *found.get(c, [None] * len(QUARTILES))) for c in columns]
    quartiles = df.sparkSession.createDataFrame(rows, "column string, p25 double, p50 double, p75 double")
    g = long.groupBy("column").agg(
        F.count("value").cast("bigint").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return g.join(F.broadcast(quartiles), "column").select(
        "column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def null_counts(df: DataFrame) -> DataFrame:
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    return _unpivot(agg, df.columns, "bigint").select("column", F.col("value").alias("nulls"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _unpivot(df, columns).distinct()


def nunique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column: one unpivot and two partial aggregates."""
    long = _unpivot(df, columns).distinct()
    return long.groupBy("column").agg(F.count("value").cast("bigint").alias("n_unique"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    g = df.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    # the total is a one-row aggregate read as a literal: no un-partitioned window, even when the
    # column has as many distinct values as rows
    total = df.agg(F.count(F.lit(1))).first()[0]
    return g.select(column, "count", F.round(F.col("count") / F.lit(total) * 100, 6).alias("percent"))


def two_way_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def share_within(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share (x 100) of each ``value`` within each ``group`` (window over the grouped counts)."""
    g = two_way_counts(df, group, value)
    return g.select(group, value, "count",
                    F.round(F.col("count") / F.sum("count").over(Window.partitionBy(group)) * 100, 6).alias("percent"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed on the right."""
    mm = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = float(mm["lo"] or 0), float(mm["hi"] or 0)  # an empty column has all counts 0
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(column).cast("double")
    idx = F.least(F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo if hi > lo else 1.0)), F.lit(bins - 1))
    g = df.where(F.col(column).isNotNull()).groupBy(idx.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("bigint").alias("bin"))
    # the bin grid has exactly ``bins`` rows: broadcasting it is bounded
    out = F.broadcast(grid).join(g, "bin", "left")
    return out.select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lower"),
                      F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("upper"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def kde(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max], Scott's bandwidth (sample std x
    n^(-1/5)). The data is compressed to (value, multiplicity) first; each distinct value is then
    expanded over the fixed grid (generate, not a join) and summed per grid point."""
    s = df.agg(F.count(column).alias("n"), F.stddev_samp(F.col(column).cast("double")).alias("sd"),
               F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not s["n"] or not s["sd"]:
        raise ValueError(f"the density of {column} needs two different values")
    n, sd, lo, hi = int(s["n"]), float(s["sd"]), float(s["lo"]), float(s["hi"])
    h = sd * n ** (-1.0 / 5.0)
    step = (hi - lo) / (points - 1)
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo + i * step).alias("x")) for i in range(points)])
    cells = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ex = cells.select("v", "c", F.inline(grid))
    z = (F.col("x") - F.col("v")) / F.lit(h)
    dens = ex.groupBy("i", "x").agg(F.sum(F.col("c") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    return dens.select(F.col("i").cast("bigint").alias("point"), F.round("x", 6).alias("x"),
                       F.round(F.col("s") / F.lit(n * h * math.sqrt(2 * math.pi)), 9).alias("density"))


def tenure_band(col: Column) -> Column:
    expr = None
    for lo, hi, name in TENURE_BANDS:
        cond = (col >= lo) & (col <= hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def segment_rates(cleaned: DataFrame) -> DataFrame:
    """Churn rate per segment of seven dimensions in one GROUPING SETS aggregate."""
    base = cleaned.select(
        F.col("contract"), F.col("internet_service"), F.col("payment_method"),
        tenure_band(F.col("tenure_months")).alias("tenure_band"),
        F.col("senior_citizen").cast("string").alias("senior_citizen"), F.col("gender"), F.col("tech_support"),
        F.col(cs.TARGET).alias("y"))
    dims = [F.col(d) for d in SEGMENT_DIMENSIONS]
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in SEGMENT_DIMENSIONS])
    rates = base.groupingSets([[d] for d in dims], *dims).agg(
        which.alias("dimension"), F.count("*").cast("bigint").alias("customers"), F.round(F.avg("y"), 6).alias("churn_rate"))
    return rates.select("dimension", F.coalesce(*dims).alias("segment"), "customers", "churn_rate")


def churn_medians(cleaned: DataFrame) -> DataFrame:
    """Medians of tenure and monthly charge for churned vs all customers; churned revenue share."""
    churned = F.col(cs.TARGET) == 1
    measures = [(name, col) for name, col in (("tenure", "tenure_months"), ("monthly", "monthly_charges"))]
    pairs = F.array(*[F.struct(F.lit(f"median_{name}_{who}").alias("column"), F.when(mine, F.col(col).cast("double")).alias("value"))
                      for name, col in measures for who, mine in (("all", F.lit(True)), ("churned", churned))])
    medians = exact_quantiles(cleaned.select(F.inline(pairs)), (0.5,))
    names = [f"median_{name}_{who}" for name, _ in measures for who in ("all", "churned")]
    return cleaned.agg(
        F.round(F.sum(F.when(churned, F.col("monthly_charges")).otherwise(0.0)) / F.sum("monthly_charges"), 6)
        .alias("churned_revenue_share")).select(*[F.lit(medians.get(n, [None])[0]).cast("double").alias(n) for n in names], "churned_revenue_share")
