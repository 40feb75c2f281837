"""Registered subgroup-audit queries over ``scored_lines`` (attributes: return flag, line status,
supplier region; evaluation sets: a group-safe holdout by order and the remaining dev rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import audit as au
from churnlens.operators import evaluate as ev
from churnlens.operators import features as ft
from churnlens.operators import resample as rs
from churnlens.operators import splits as sp
from churnlens.plans import pipeline as pl
from churnlens.plans import sql_fixtures as sq
from churnlens.plans.q_eval import FOLD_SQL, fold_col, ranking_sql, sweep_sql
from churnlens.plans.q_models import HOLDOUT_SQL
from churnlens.session import stored
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


ATTRS = ("l_returnflag", "l_linestatus", "region")
ROWKEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
N_BOOT = 500
N_BOOT_CHECK = 20  # bootstrap_ci hashes each row B times, also in SQL
SEED = 42
HIGH = 0.5


def audit_frame(spark: SparkSession, sf: str) -> DataFrame:
    sl = fx.scored_lines(spark, sf)
    return sl.withColumn("eval_set", F.when(fold_col() == 0, "holdout").otherwise("dev"))


def thresholds(frame: DataFrame) -> dict[str, float]:
    """best_f1 is fixed on the dev rows only (a 91-row table, read as one value)."""
    best = ev.best_f1_threshold(frame.where(F.col("eval_set") == "dev")).first()
    return {"best_f1": float(best["best_f1_threshold"]), "high_band": HIGH}


def long_frame(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, float]]:
    f = audit_frame(spark, sf)
    return au.unpivot(f, ATTRS, keep=ROWKEY), thresholds(f)


SLE = f"(SELECT *, CASE WHEN {FOLD_SQL} = 0 THEN 'holdout' ELSE 'dev' END AS eval_set FROM {sq.scored_lines_sql()} s)"
LONG = "(" + " UNION ALL ".join(
    f"SELECT eval_set, '{a}' AS attribute, CAST({a} AS VARCHAR) AS value, y, p, {', '.join(ROWKEY)} FROM {SLE} x"
    for a in ATTRS) + ")"


def best_sql(src: str) -> str:
    """The F1-best threshold of the dev rows of ``src``."""
    dev = f"(SELECT * FROM {src} d WHERE eval_set = 'dev')"
    return (f"(SELECT CASE WHEN f1 IS NOT NULL THEN threshold ELSE {min(ev.F1_GRID)!r} END FROM "
            f"({sweep_sql(ev.F1_GRID, dev)}) b ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1)")


BEST = best_sql(SLE)
GK = ["eval_set", "attribute", "value"]
THR = {"best_f1": "t1", "high_band": "t2"}


def _metrics_select(rounded: bool = True) -> str:
    def r(x: str) -> str:
        return f"round({x}, 6)" if rounded else f"({x})"
    cols = [
        f"CASE WHEN n > 0 THEN {r('pos / n')} END AS observed_churn_rate",
        f"CASE WHEN n > 0 THEN {r('sp / n')} END AS mean_predicted_risk",
        f"CASE WHEN n > 0 THEN {r('sp / n - pos / n')} END AS calibration_gap",
        "roc_auc", "pr_auc",
    ]
    for name, t in THR.items():
        cols += [
            f"CASE WHEN n > 0 THEN {r(f'f_{t} / n')} END AS selection_rate_at_{name}",
            f"CASE WHEN pos > 0 THEN {r(f'tp_{t} / pos')} END AS tpr_at_{name}",
            f"CASE WHEN n - pos > 0 THEN {r(f'(f_{t} - tp_{t}) / (n - pos)')} END AS fpr_at_{name}",
            f"CASE WHEN f_{t} > 0 THEN {r(f'tp_{t} / f_{t}')} END AS precision_at_{name}",
        ]
    return ", ".join(cols)


def _group_sql(src: str, keys: list[str], weight: str = "1", rounded: bool = True, best: str = BEST) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"g.{c} = r.{c}" for c in keys)
    sums = ", ".join(
        f"sum({weight} * CASE WHEN p >= {t} THEN 1 ELSE 0 END)::DOUBLE AS f_{t}, "
        f"sum({weight} * CASE WHEN p >= {t} THEN y ELSE 0 END)::DOUBLE AS tp_{t}" for t in THR.values())
    rank = ranking_sql(keys, src=src, weight=weight)
    return f"""WITH thr AS (SELECT {best} AS t1, CAST({HIGH} AS DOUBLE) AS t2),
g AS (SELECT {k}, sum({weight})::DOUBLE AS n, sum({weight} * y)::DOUBLE AS pos, sum({weight} * p) AS sp, {sums}
      FROM {src} s, thr GROUP BY {k}),
r AS ({rank})
SELECT {k}, CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS n_churned, {_metrics_select(rounded)}
FROM (SELECT g.*, r.roc_auc, r.pr_auc FROM g LEFT JOIN r ON {on}) x"""


STATUS = (f"CASE WHEN n >= 30 AND n_churned >= 5 AND n - n_churned >= 5 THEN 'ok' ELSE '{au.INSUFFICIENT}' END")


def group_metrics_sql(src: str = LONG, best: str = BEST) -> str:
    names = au.metric_names({"best_f1": 0, "high_band": 0})
    cols = ", ".join(f"CASE WHEN status = 'ok' THEN {m} END AS {m}" for m in names)
    return f"""SELECT eval_set, attribute, value, n, n_churned, status, {cols}
FROM (SELECT *, {STATUS} AS status FROM ({_group_sql(src, GK, best=best)}) a) b"""


@q("audit_join", f"""SELECT CAST(count(*) AS BIGINT) AS n_scored,
  CAST(count_if(l_returnflag IS NULL OR l_linestatus IS NULL OR region IS NULL) AS BIGINT) AS missing_attributes
FROM {SLE} s""")
def audit_join(spark: SparkSession, sf: str) -> DataFrame:
    f = audit_frame(spark, sf)
    pred = f.select(*ROWKEY, "l_shipdate", "l_extendedprice", "y", "p")
    attrs = f.select(*ROWKEY, "l_shipdate", "l_extendedprice", *ATTRS)
    keys = [*ROWKEY, "l_shipdate", "l_extendedprice"]
    j = pred.join(attrs, keys, "left")
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n_scored"),
                 F.sum(F.greatest(*[F.col(a).isNull().cast("int") for a in ATTRS])).cast("bigint")
                 .alias("missing_attributes"))


@q("group_sufficiency", f"""SELECT eval_set, attribute, value, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(y) AS BIGINT) AS n_churned, CASE WHEN count(*) >= 30 AND sum(y) >= 5 AND count(*) - sum(y) >= 5 THEN 'ok'
  ELSE '{au.INSUFFICIENT}' END AS status FROM {LONG} l GROUP BY eval_set, attribute, value""")
def group_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    long, _ = long_frame(spark, sf)
    return au.sufficiency(long)


@q("group_metrics", group_metrics_sql())
def group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    long, thr = long_frame(spark, sf)
    return au.group_metrics(long, thr)


def _long_metrics_sql(src: str, keys: list[str]) -> str:
    names = au.metric_names({"best_f1": 0, "high_band": 0})
    k = ", ".join(keys)
    return (f"SELECT {k}, metric, mval FROM (SELECT {k}, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in names)} "
            f"FROM ({src}) z) x UNPIVOT INCLUDE NULLS (mval FOR metric IN ({', '.join(names)}))")


@q("group_differences", f"""WITH pm AS ({group_metrics_sql()}),
l AS ({_long_metrics_sql("SELECT * FROM pm WHERE status = 'ok'", ['eval_set', 'attribute', 'value'])})
SELECT a.eval_set, a.attribute, a.metric, a.value AS group_a, b.value AS group_b, round(b.mval - a.mval, 6) AS estimate
FROM l a JOIN l b ON a.eval_set = b.eval_set AND a.attribute = b.attribute AND a.metric = b.metric AND a.value < b.value
WHERE a.mval IS NOT NULL AND b.mval IS NOT NULL""")
def group_differences(spark: SparkSession, sf: str) -> DataFrame:
    long, thr = long_frame(spark, sf)
    return au.differences(au.group_metrics(long, thr), None, thr, 0)


def _boot_sql(n_boot: int) -> str:
    rk = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in ROWKEY)
    u = (f"(CAST(('0x' || substr(md5('{SEED}:' || attribute || ':' || CAST(b AS VARCHAR) || ':' || {rk}), 1, 8))"
         f" AS BIGINT) / 4294967296.0)")
    cdf = au.poisson1_cdf_points(10)
    w = "CASE " + " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(cdf)) + " ELSE 11 END"
    ok = f"(SELECT eval_set, attribute, value FROM ({group_metrics_sql()}) q WHERE status = 'ok')"
    cells = f"""(SELECT eval_set, attribute, value, b AS replicate, p, y, sum(w) AS w FROM (
      SELECT l.*, r.b, {w} AS w FROM {LONG} l SEMI JOIN {ok} o USING (eval_set, attribute, value),
        range(0, {n_boot}) r(b)) z GROUP BY eval_set, attribute, value, b, p, y HAVING sum(w) > 0)"""
    keys = ["eval_set", "attribute", "value", "replicate"]
    rep = _group_sql(cells, keys, weight="w", rounded=False)
    guard = max(10, int(0.5 * n_boot))
    return f"""WITH lm AS ({_long_metrics_sql(rep, keys)})
SELECT eval_set, attribute, value AS grp, metric,
  CASE WHEN count(v) >= {guard} THEN round(quantile_cont(v, 0.025), 6) END AS ci_low,
  CASE WHEN count(v) >= {guard} THEN round(quantile_cont(v, 0.975), 6) END AS ci_high
FROM (SELECT *, CASE WHEN NOT isnan(mval) THEN mval END AS v FROM lm) x GROUP BY eval_set, attribute, value, metric"""


@q("bootstrap_ci", _boot_sql(N_BOOT_CHECK))
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile intervals with per-row Poisson(1) weights (SQL-reproducible variant, B = 20)."""
    long, thr = long_frame(spark, sf)
    _, ci = au.bootstrap_intervals(long, thr, N_BOOT_CHECK, ROWKEY, SEED)
    return ci


@q("bootstrap_cells")
def bootstrap_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Exact multinomial bootstrap of all subgroups, B = 500: 95% intervals."""
    long, thr = long_frame(spark, sf)
    return au.intervals(rs.replicate_metrics(long, thr, N_BOOT, SEED), ["eval_set", "attribute", "grp", "metric"], N_BOOT)


@q("bootstrap_differences")
def bootstrap_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between the values of an attribute with intervals of replicate-wise differences, B = 500."""
    long, thr = long_frame(spark, sf)
    replicates = stored(rs.replicate_metrics(long, thr, N_BOOT, SEED), "replicates")
    return au.differences(stored(au.group_metrics(long, thr), "points"), replicates, thr, N_BOOT)


# -- accounts: four attributes, joined to the predictions by customer id ---------------------------

ACCOUNT_PRED = (f"(SELECT CASE WHEN h.is_test THEN 'holdout' ELSE 'dev' END AS eval_set, h.customer_id, h.churn AS y, s.risk_score AS p "
                f"FROM {HOLDOUT_SQL} h JOIN (SELECT customer_id, risk_score FROM {sq.scored_accounts_sql()} z) s USING (customer_id))")
ACCOUNT_LONG = "(" + " UNION ALL ".join(
    f"SELECT eval_set, '{a}' AS attribute, CAST({a} AS VARCHAR) AS value, y, p FROM {ACCOUNT_PRED} p JOIN {sq.cleaned_sql()} c USING (customer_id)"
    for a in cs.AUDIT_ATTRIBUTES) + ")"


def account_predictions(cleaned: DataFrame) -> DataFrame:
    split = sp.holdout_split(pl.score(ft.derive_features(cleaned)), cs.SEED)
    return split.select(F.when(F.col("is_test"), "holdout").otherwise("dev").alias("eval_set"), cs.CLEAN_ID, F.col(cs.TARGET).alias("y"), F.col("risk_score").alias("p"))


@q("account_audit_join", f"""SELECT CAST(count(*) AS BIGINT) AS n_scored, CAST(count_if(c.customer_id IS NULL) AS BIGINT) AS unmatched,
  CAST(count_if({" OR ".join(f"c.{a} IS NULL" for a in cs.AUDIT_ATTRIBUTES)}) AS BIGINT) AS missing_attributes
FROM {ACCOUNT_PRED} p LEFT JOIN (SELECT * FROM {sq.cleaned_sql()} k WHERE contract <> 'Two year') c USING (customer_id)""")
def account_audit_join(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's join check on predictions of all accounts and attributes of those without a
    two-year contract: the others are the unmatched ones that the audit refuses."""
    cleaned = pl.cleaned_accounts(spark, sf)
    return au.join_check(account_predictions(cleaned), cleaned.where("contract <> 'Two year'"))


@q("account_group_metrics", group_metrics_sql(ACCOUNT_LONG, best_sql(ACCOUNT_PRED)))
def account_group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Four attributes x two evaluation sets of the fixed model: points of the full audit."""
    cleaned = pl.cleaned_accounts(spark, sf)
    pred = stored(account_predictions(cleaned), "account-predictions")
    long = au.unpivot(au.attach_attributes(pred, cleaned), cs.AUDIT_ATTRIBUTES)
    return au.group_metrics(long, thresholds(pred))
