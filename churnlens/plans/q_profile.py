"""Registered exploratory queries over the accounts fixture and the driver's customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import clean as cl
from churnlens.operators import profile as pf
from churnlens.plans import pipeline as pl
from churnlens.plans import sql_fixtures as sq
from churnlens.sources import fixtures as fx
from churnlens.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


A = sq.accounts_sql()
CLEAN = sq.cleaned_sql()
NUMERIC = ("tenure_months", "monthly_charges", "total_charges", "senior_citizen")
CUSTOMER_COLS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return fx.accounts(spark, sf).drop(fx.ROW)


def _describe_sql(src: str, columns) -> str:
    parts = [
        f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, round(avg({c}::DOUBLE), 6) AS mean, "
        f"round(stddev_samp({c}::DOUBLE), 6) AS std, round(min({c}::DOUBLE), 6) AS min, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c}::DOUBLE), 6) AS max FROM {src} t"
        for c in columns]
    return " UNION ALL ".join(parts)


@q("shape", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(cs.RAW_COLUMNS)} AS BIGINT) AS n_columns FROM {A} a")
def shape(spark: SparkSession, sf: str) -> DataFrame:
    return pf.shape(raw(spark, sf))


@q("describe", _describe_sql(CLEAN, NUMERIC))
def describe(spark: SparkSession, sf: str) -> DataFrame:
    return pf.describe(pl.cleaned_accounts(spark, sf, groups=False), NUMERIC)


@q("acctbal_describe", _describe_sql("customer", ["c_acctbal", "c_nationkey"]))
def acctbal_describe(spark: SparkSession, sf: str) -> DataFrame:
    return pf.describe(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])


@q("null_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM customer" for c in CUSTOMER_COLS))
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pf.null_counts(table(spark, sf, "customer").select(*CUSTOMER_COLS))


@q("distinct_values", " UNION ".join(
    f"SELECT DISTINCT '{c}' AS column, {c} AS value FROM {A} a" for c in cs.RAW_COLUMNS))
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return pf.distinct_values(raw(spark, sf), cs.RAW_COLUMNS)


@q("nunique", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM {A} a" for c in cs.RAW_COLUMNS))
def nunique(spark: SparkSession, sf: str) -> DataFrame:
    return pf.nunique(raw(spark, sf), cs.RAW_COLUMNS)


def _vc_sql(src: str, col: str) -> str:
    return (f"SELECT {col}, CAST(count(*) AS BIGINT) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) "
            f"AS percent FROM {src} t GROUP BY {col}")


@q("value_counts", _vc_sql(A, "Churn"))
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pf.value_counts(raw(spark, sf), "Churn")


@q("segment_value_counts", _vc_sql("customer", "c_mktsegment"))
def segment_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pf.value_counts(table(spark, sf, "customer"), "c_mktsegment")


@q("blank_rows", f"SELECT customerID, tenure, MonthlyCharges, TotalCharges, Churn FROM {A} a WHERE TotalCharges = ' '")
def blank_rows(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf).where(F.col("TotalCharges") == " ").select(
        "customerID", "tenure", "MonthlyCharges", "TotalCharges", "Churn")


@q("two_way_counts", f"SELECT contract, churn, CAST(count(*) AS BIGINT) AS count FROM {CLEAN} c GROUP BY contract, churn")
def two_way_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pf.two_way_counts(pl.cleaned_accounts(spark, sf, groups=False), "contract", "churn")


@q("share_within", f"""SELECT Contract, Churn, CAST(count(*) AS BIGINT) AS count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY Contract) * 100, 6) AS percent FROM {A} a GROUP BY Contract, Churn""")
def share_within(spark: SparkSession, sf: str) -> DataFrame:
    return pf.share_within(raw(spark, sf), "Contract", "Churn")


def _hist_sql(src: str, col: str, bins: int = 30) -> str:
    return f"""WITH d AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} t WHERE {col} IS NOT NULL),
m AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
g AS (SELECT CAST(least(floor((x - lo) * {float(bins)!r} / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END), {bins - 1}) AS BIGINT)
        AS bin, count(*) AS n FROM d, m GROUP BY 1),
b AS (SELECT CAST(i AS BIGINT) AS bin FROM range(0, {bins}) r(i))
SELECT b.bin, round(lo + b.bin * CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END, 6) AS lower,
  round(lo + (b.bin + 1) * CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END, 6) AS upper,
  CAST(coalesce(g.n, 0) AS BIGINT) AS count FROM b LEFT JOIN g ON b.bin = g.bin, m"""


_DROPPED = f"(SELECT CAST(tenure AS DOUBLE) AS tenure FROM {A} a WHERE TotalCharges <> ' ')"


@q("histogram30", _hist_sql(_DROPPED, "tenure"))
def histogram30(spark: SparkSession, sf: str) -> DataFrame:
    d = cl.drop_blank_totals(raw(spark, sf)).select(F.col("tenure").cast("double").alias("tenure"))
    return pf.histogram(d, "tenure", 30)


@q("acctbal_histogram30", _hist_sql("customer", "c_acctbal"))
def acctbal_histogram30(spark: SparkSession, sf: str) -> DataFrame:
    return pf.histogram(table(spark, sf, "customer"), "c_acctbal", 30)


@q("kde_grid", f"""WITH d AS (SELECT CAST(tenure AS DOUBLE) AS v FROM {_DROPPED} t),
s AS (SELECT count(v) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM d),
k AS (SELECT n, sd * pow(n, -1.0 / 5.0) AS h, lo, (hi - lo) / 99 AS step FROM s),
c AS (SELECT v, count(*) AS c FROM d GROUP BY v),
g AS (SELECT CAST(i AS BIGINT) AS point, lo + i * step AS x, n, h FROM range(0, 100) r(i), k)
SELECT point, round(x, 6) AS x, round(sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())), 9)
  AS density FROM g, c GROUP BY point, x, n, h""")
def kde_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = cl.drop_blank_totals(raw(spark, sf)).select(F.col("tenure").cast("double").alias("tenure"))
    return pf.kde(d, "tenure", 100)


def _segments_sql() -> str:
    band = " ".join(f"WHEN tenure_months BETWEEN {lo} AND {hi} THEN '{nm}'" for lo, hi, nm in pf.TENURE_BANDS)
    src = (f"(SELECT contract, internet_service, payment_method, CASE {band} END AS tenure_band, "
           f"CAST(senior_citizen AS VARCHAR) AS senior_citizen, gender, tech_support, churn AS y FROM {CLEAN} c)")
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS segment, CAST(count(*) AS BIGINT) AS customers, round(avg(y), 6) AS churn_rate "
        f"FROM {src} s GROUP BY {d}" for d in pf.SEGMENT_DIMENSIONS)


@q("segment_rates", _segments_sql())
def segment_rates(spark: SparkSession, sf: str) -> DataFrame:
    return pf.segment_rates(pl.cleaned_accounts(spark, sf, groups=False))


@q("churn_medians", f"""SELECT quantile_cont(tenure_months, 0.5) AS median_tenure_all,
  quantile_cont(tenure_months, 0.5) FILTER (WHERE churn = 1) AS median_tenure_churned,
  quantile_cont(monthly_charges, 0.5) AS median_monthly_all,
  quantile_cont(monthly_charges, 0.5) FILTER (WHERE churn = 1) AS median_monthly_churned,
  round(sum(CASE WHEN churn = 1 THEN monthly_charges ELSE 0.0 END) / sum(monthly_charges), 6) AS churned_revenue_share
FROM {CLEAN} c""")
def churn_medians(spark: SparkSession, sf: str) -> DataFrame:
    return pf.churn_medians(pl.cleaned_accounts(spark, sf, groups=False))
