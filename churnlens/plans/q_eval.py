"""Registered evaluation queries over ``scored_lines`` (one scored row per lineitem)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import evaluate as ev
from churnlens.plans import sql_fixtures as sq
from churnlens.sources import fixtures as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SL = sq.scored_lines_sql()
KEY = list(fx.LINE_KEY)
KEY_SQL = ", ".join(KEY)


def fold_col() -> F.Column:
    h = F.md5(F.concat(F.lit("fold:"), F.col("l_orderkey").cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(5)).cast("bigint")


FOLD_SQL = "CAST((CAST(('0x' || substr(md5('fold:' || CAST(l_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 5) AS BIGINT)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return fx.scored_lines(spark, sf, with_region=False)


def ranking_sql(keys: list[str], src: str = SL, extra: str = "", weight: str = "1") -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    w = f"OVER ({part}ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    g = f"GROUP BY {k}" if keys else ""
    return f"""WITH sl AS (SELECT *{extra} FROM {src} s),
h AS (SELECT {kc}p, sum({weight} * y)::DOUBLE AS pos, sum({weight} * (1 - y))::DOUBLE AS neg FROM sl GROUP BY {kc}p),
c AS (SELECT *, sum(pos) {w} AS cum_pos, sum(neg) {w} AS cum_neg,
        least(greatest(p, 1e-15), 1 - 1e-15) AS pc FROM h),
a AS (SELECT {kc}sum(pos) AS P, sum(neg) AS N, sum(pos * cum_neg) AS s_pc, sum(pos * neg) AS s_pn,
        sum(pos * (cum_pos / (cum_pos + cum_neg))) AS s_ap,
        sum(pos * pow(1.0 - p, 2) + neg * pow(p, 2)) AS b, sum(-(pos * ln(pc) + neg * ln(1.0 - pc))) AS ll
      FROM c {g})
SELECT {kc}CAST(P + N AS BIGINT) AS n,
  CASE WHEN P > 0 AND N > 0 THEN round((P * N - s_pc + 0.5 * s_pn) / (P * N), 6) END AS roc_auc,
  CASE WHEN P > 0 AND N > 0 THEN round(s_ap / P, 6) END AS pr_auc,
  CASE WHEN P + N > 0 THEN round(b / (P + N), 6) END AS brier,
  CASE WHEN P + N > 0 THEN round(ll / (P + N), 6) END AS log_loss
FROM a"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v) for v in r) + ")"
                     for r in rows)


def sweep_sql(thresholds, src: str = SL) -> str:
    thr = sorted(float(t) for t in thresholds)
    vals = _values([(i, t) for i, t in enumerate(thr)])
    return f"""WITH sl AS (SELECT * FROM {src} s), t AS (SELECT * FROM (VALUES {vals}) t(t_idx, threshold)),
c AS (SELECT t_idx, threshold, sum(CASE WHEN p >= threshold THEN y ELSE 0 END)::DOUBLE AS tp,
        sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END)::DOUBLE AS fp,
        sum(y)::DOUBLE AS P, sum(1 - y)::DOUBLE AS N FROM sl, t GROUP BY t_idx, threshold),
m AS (SELECT t_idx, round(threshold, 6) AS threshold,
        CASE WHEN tp + fp <> 0 THEN round(tp / (tp + fp), 6) END AS precision,
        CASE WHEN P <> 0 THEN round(tp / P, 6) END AS recall,
        CASE WHEN N <> 0 THEN round(fp / N, 6) END AS false_positive_rate,
        CASE WHEN P + N <> 0 THEN round((tp + fp) / (P + N), 6) END AS selection_rate,
        CAST(N - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(P - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
      FROM c)
SELECT *, CASE WHEN precision IS NOT NULL AND recall IS NOT NULL AND precision + recall > 0
  THEN round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM m"""


SWEEP_COLS = ["threshold", "precision", "recall", "f1", "false_positive_rate", "selection_rate", "tn", "fp", "fn", "tp"]


@q("roc_auc", f"SELECT n, roc_auc FROM ({ranking_sql([])}) x")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ranking_metrics(lines(spark, sf)).select("n", "roc_auc")


@q("pr_auc", f"SELECT n, pr_auc FROM ({ranking_sql([])}) x")
def pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ranking_metrics(lines(spark, sf)).select("n", "pr_auc")


@q("brier_logloss", f"SELECT n, brier, log_loss FROM ({ranking_sql([])}) x")
def brier_logloss(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ranking_metrics(lines(spark, sf)).select("n", "brier", "log_loss")


@q("metrics_by_fold", ranking_sql(["fold"], extra=f", {FOLD_SQL} AS fold"))
def metrics_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ranking_metrics(lines(spark, sf).withColumn("fold", fold_col()), ["fold"])


@q("threshold_metrics", f"SELECT {', '.join(SWEEP_COLS)} FROM ({sweep_sql([0.5])}) x")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.threshold_table(lines(spark, sf), [0.5]).select(*SWEEP_COLS)


@q("threshold_sweep", f"SELECT {', '.join(SWEEP_COLS)} FROM ({sweep_sql(ev.SWEEP_THRESHOLDS)}) x")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return ev.threshold_table(lines(spark, sf), ev.SWEEP_THRESHOLDS).select(*SWEEP_COLS)


@q("best_f1", f"""SELECT CASE WHEN f1 IS NOT NULL THEN threshold ELSE {min(ev.F1_GRID)!r} END AS best_f1_threshold,
  f1 AS best_f1 FROM ({sweep_sql(ev.F1_GRID)}) x ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1""")
def best_f1(spark: SparkSession, sf: str) -> DataFrame:
    return ev.best_f1_threshold(lines(spark, sf))


def cost_sql(src: str = SL) -> str:
    ratios = ", ".join(f"(CAST({float(r)!r} AS DOUBLE))" for r in ev.ASSUMED_COST_RATIOS)
    return f"""WITH s AS ({sweep_sql(ev.COST_GRID, src)}), r AS (SELECT * FROM (VALUES {ratios}) r(ratio)),
c AS (SELECT r.ratio, s.*, r.ratio * s.fn + s.fp AS cost FROM s, r),
b AS (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY cost, threshold) AS rk FROM c)
SELECT ratio AS assumed_cost_ratio_fn_to_fp, '{ev.COST_BASIS}' AS basis, round(threshold, 2) AS threshold,
  precision, recall, selection_rate FROM b WHERE rk = 1"""


@q("cost_ratio", cost_sql())
def cost_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return ev.cost_ratio_table(lines(spark, sf))


def capacity_sql(src: str = SL) -> str:
    fr = ", ".join(f"(CAST({f!r} AS DOUBLE))" for f in ev.CAPACITY_FRACTIONS)
    return f"""WITH sl AS (SELECT * FROM {src} s),
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, {KEY_SQL}) AS rk FROM sl),
tot AS (SELECT count(*) AS n, sum(y) AS P FROM sl),
k AS (SELECT fr, greatest(1, CAST(round_even(fr * n, 0) AS BIGINT)) AS k, n, P FROM (VALUES {fr}) f(fr), tot),
h AS (SELECT k.fr, k.k, k.n, k.P, sum(CASE WHEN r.rk <= k.k THEN r.y ELSE 0 END) AS hits FROM k, r GROUP BY k.fr, k.k, k.n, k.P)
SELECT round(fr, 6) AS top_fraction, k AS customers_contacted, round(hits / k, 6) AS precision,
  CASE WHEN P > 0 THEN round(hits / P, 6) END AS recall,
  CASE WHEN P > 0 THEN round((hits / k) / (P / n), 6) END AS lift_over_base_rate FROM h"""


@q("capacity_table", capacity_sql())
def capacity_table(spark: SparkSession, sf: str) -> DataFrame:
    return ev.capacity_table(lines(spark, sf), KEY)


def _bins_sql(n_bins: int, src: str = SL) -> str:
    return f"""WITH sl AS (SELECT * FROM {src} s),
r AS (SELECT y, p, row_number() OVER (ORDER BY p, {KEY_SQL}) - 1 AS r0 FROM sl),
t AS (SELECT count(*) AS n FROM sl),
b AS (SELECT r.*, t.n, CASE WHEN r0 < (t.n // {n_bins} + 1) * (t.n % {n_bins}) THEN r0 // (t.n // {n_bins} + 1)
      ELSE (t.n % {n_bins}) + (r0 - (t.n // {n_bins} + 1) * (t.n % {n_bins})) // (t.n // {n_bins}) END AS bin FROM r, t)"""


@q("calibration_table", _bins_sql(10) + """
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_predicted,
  round(avg(y::DOUBLE), 6) AS observed_rate FROM b GROUP BY bin""")
def calibration_table(spark: SparkSession, sf: str) -> DataFrame:
    return ev.calibration_table(lines(spark, sf), KEY, 10)


@q("calibration_summary", _bins_sql(10) + """,
g AS (SELECT bin, count(*) AS nb, max(n) AS n, avg(p) AS mp, avg(y::DOUBLE) AS obs, sum(p) AS sp, sum(y) AS sy FROM b GROUP BY bin)
SELECT round(sum(nb / n * abs(mp - obs)), 6) AS expected_calibration_error, round(sum(sp) / sum(nb), 6) AS mean_predicted,
  round(sum(sy) / sum(nb), 6) AS observed_rate FROM g""")
def calibration_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.calibration_summary(lines(spark, sf), KEY, 10)


def band_table_sql(src: str = SL, keys: list[str] | None = None, band_expr: str | None = None) -> str:
    keys = keys or []
    kc = "".join(f"{k}, " for k in keys)
    band = band_expr or sq.band_sql("p").replace("WHEN p >= 0 THEN 'LOW' END", "ELSE 'LOW' END")
    on = " AND ".join([f"d.{k} = g.{k}" for k in keys] + ["d.band = g.band"])
    dk = "".join(f"d.{k}, " for k in keys)
    return f"""WITH sl AS (SELECT * FROM {src} s),
g AS (SELECT {kc}{band} AS band, count(*) AS customers, sum(y) AS churners FROM sl GROUP BY {kc}{band}),
t AS (SELECT {kc}sum(customers) AS total FROM g {'GROUP BY ' + ', '.join(keys) if keys else ''}),
d AS (SELECT t.*, b.band, b.band_order FROM t, (VALUES ('LOW', 0), ('MEDIUM', 1), ('HIGH', 2)) b(band, band_order))
SELECT {dk}d.band, CAST(d.band_order AS INTEGER) AS band_order, CAST(coalesce(g.customers, 0) AS BIGINT) AS customers,
  CASE WHEN d.total > 0 THEN round(coalesce(g.customers, 0) / d.total, 6) END AS share_of_customers,
  CASE WHEN coalesce(g.customers, 0) > 0 THEN round(coalesce(g.churners, 0) / g.customers, 6) END AS observed_churn_rate,
  CAST(coalesce(g.churners, 0) AS BIGINT) AS churners
FROM d LEFT JOIN g ON {on}"""


@q("band_table", band_table_sql())
def band_table(spark: SparkSession, sf: str) -> DataFrame:
    return ev.band_table(lines(spark, sf))
