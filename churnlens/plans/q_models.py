"""Registered split, cross-validation and model queries over the accounts fixture.

SQL-checkable "models" are the prior baseline (trained per fold: the training prevalence) and the
fixed-coefficient logistic model with feature-group ablations (coefficients of the dropped group
set to zero); they exercise fold assignment, per-fold metrics, summaries, paired differences and
model selection exactly. Training (the train flow, its audit, logistic regression, histogram boosting,
random forest) is registered without an oracle (rows-only check).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import design as dz
from churnlens.operators import evaluate as ev
from churnlens.operators import features as ft
from churnlens.operators import keyed_boost as kb
from churnlens.operators import keyed_logit as kl
from churnlens.operators import models as md
from churnlens.operators import scoring as sc
from churnlens.operators import splits as sp
from churnlens.plans import pipeline as pl
from churnlens.plans import sql_fixtures as sq
from churnlens.plans import train_flow as tf
from churnlens.plans.q_eval import band_table_sql, ranking_sql
from churnlens.session import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


K, R, SEED = 5, 3, cs.SEED
FEAT = sq.features_sql()


def _variant(drop: tuple[str, ...]) -> sc.LinearModel:
    m = sc.fixed_account_model()
    coef = {n: (0.0 if src in drop else v) for (n, src, _), v in zip(m.pre.encoded, [m.coef[e[0]] for e in m.pre.encoded])}
    return replace(m, coef=coef)


FIXED_MODELS = {
    "fixed_logistic": _variant(()),
    "fixed_without_contract": _variant(("contract",)),
    "fixed_without_total_charges": _variant(("total_charges",)),
    "fixed_without_contract_and_total_charges": _variant(("contract", "total_charges")),
}
MODEL_ORDER = ("prior_baseline", *FIXED_MODELS)


def _folds_sql(n_repeats: int = R, seed: int = SEED, src: str = FEAT) -> str:
    return f"""WITH f AS (SELECT * FROM {src} x),
grp AS (SELECT duplicate_group_id, max(churn) AS stratum FROM f GROUP BY duplicate_group_id),
rg AS (SELECT g.*, rep.repeat FROM grp g, range(0, {n_repeats}) rep(repeat)),
rk AS (SELECT duplicate_group_id, CAST(repeat AS BIGINT) AS repeat, CAST((row_number() OVER (PARTITION BY repeat, stratum
        ORDER BY md5(CAST({seed} + repeat AS VARCHAR) || ':' || CAST(duplicate_group_id AS VARCHAR)), duplicate_group_id) - 1)
        % 5 AS BIGINT) AS fold FROM rg)"""


def folds_rows_sql(n_repeats: int = R, seed: int = SEED) -> str:
    return f"""({_folds_sql(n_repeats, seed)}
SELECT f.*, rk.repeat, rk.fold FROM f JOIN rk USING (duplicate_group_id))"""


def account_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Stored: the priors and every model read the rows again."""
    return stored(sp.assign_folds(pl.scored_accounts(spark, sf), K, R, SEED), "folds")


@q("fold_assign", f"SELECT customer_id, repeat, fold FROM {folds_rows_sql()} x")
def fold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return account_folds(spark, sf).select(cs.CLEAN_ID, "repeat", "fold")


HOLDOUT_SQL = f"(SELECT *, fold = 0 AS is_test FROM {folds_rows_sql(1, SEED + 1000)} x)"


@q("holdout_split", f"SELECT customer_id, is_test FROM {HOLDOUT_SQL} h")
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    return sp.holdout_split(pl.scored_accounts(spark, sf), SEED).select(cs.CLEAN_ID, "is_test")


@q("fold_integrity", "SELECT CAST(0 AS BIGINT) AS rows_not_once, CAST(0 AS BIGINT) AS groups_split, "
                     "CAST(0 AS BIGINT) AS rows_in_both")
def fold_integrity(spark: SparkSession, sf: str) -> DataFrame:
    sa = pl.scored_accounts(spark, sf)
    return sp.fold_integrity(sp.assign_folds(sa, K, R, SEED), sp.holdout_split(sa, SEED))


@q("label_shuffle", f"""WITH f AS (SELECT * FROM {FEAT} x),
a AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS r FROM f),
b AS (SELECT churn, row_number() OVER (ORDER BY md5('{SEED}:' || customer_id), customer_id) AS r FROM f)
SELECT a.customer_id, b.churn AS churn_shuffled FROM a JOIN b USING (r)""")
def label_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return sp.label_shuffle(pl.account_features(spark, sf, groups=False), SEED)


# -- models on identical folds ------------------------------------------------------------------

def prior_by_fold(rows: DataFrame) -> DataFrame:
    """Training prevalence of each (repeat, fold) from per-fold counts (no per-fold scans)."""
    per = rows.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("nv"), F.sum(cs.TARGET).alias("pv"))
    tot = rows.where(F.col("repeat") == 0).agg(F.count(F.lit(1)).alias("n"), F.sum(cs.TARGET).alias("pos")).first()
    return per.select("repeat", "fold", F.round((F.lit(tot["pos"]) - F.col("pv")) / (F.lit(tot["n"]) - F.col("nv")), 6)
                      .alias("prior"))


PRIOR_SQL = f"""(WITH rows AS (SELECT * FROM {folds_rows_sql()} z), tot AS (SELECT count(*) AS n, sum(churn) AS pos FROM rows WHERE repeat = 0)
SELECT repeat, fold, round((tot.pos - sum(churn)) / (tot.n - count(*)), 6) AS prior FROM rows, tot
GROUP BY repeat, fold, tot.pos, tot.n)"""


@q("prior_baseline", f"SELECT * FROM {PRIOR_SQL} p")
def prior_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return prior_by_fold(account_folds(spark, sf))


def oof_predictions(rows: DataFrame) -> DataFrame:
    """model, repeat, fold, customer_id, y, p for every SQL-reproducible model (validation rows)."""
    prior = prior_by_fold(rows)
    made = rows.select("repeat", "fold", cs.CLEAN_ID, F.col(cs.TARGET).alias("y"), *[F.round(m.probability(), 6).alias(name) for name, m in FIXED_MODELS.items()])
    models = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p")) for name, c in (("prior_baseline", "prior"), *zip(FIXED_MODELS, FIXED_MODELS, strict=True))])
    return made.join(F.broadcast(prior), ["repeat", "fold"]).select("repeat", "fold", cs.CLEAN_ID, "y", F.inline(models)) \
        .select("model", "repeat", "fold", cs.CLEAN_ID, "y", "p")


OOF_SQL = f"""(WITH rows AS (SELECT * FROM {folds_rows_sql()} z), pr AS (SELECT * FROM {PRIOR_SQL} q)
SELECT 'prior_baseline' AS model, rows.repeat, rows.fold, customer_id, churn AS y, pr.prior AS p
FROM rows JOIN pr ON rows.repeat = pr.repeat AND rows.fold = pr.fold
""" + "".join(
    f"UNION ALL SELECT '{n}' AS model, repeat, fold, customer_id, churn AS y, round(1.0 / (1.0 + exp(-({m.sql_decision()}))), 6) AS p FROM rows\n"
    for n, m in FIXED_MODELS.items()) + ")"


@q("oof_mean", f"""SELECT customer_id, CAST(min(y) AS BIGINT) AS y, round(avg(p), 6) AS p_oof FROM {OOF_SQL} o
WHERE model = 'prior_baseline' GROUP BY customer_id""")
def oof_mean(spark: SparkSession, sf: str) -> DataFrame:
    oof = oof_predictions(account_folds(spark, sf)).where(F.col("model") == "prior_baseline")
    m = md.oof_mean(oof)
    return m.select(cs.CLEAN_ID, F.col("y").cast("bigint").alias("y"), F.round("p_oof", 6).alias("p_oof"))


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ranking_metrics(oof_predictions(account_folds(spark, sf)), ["model", "repeat", "fold"])


FOLD_METRICS_SQL = f"({ranking_sql(['model', 'repeat', 'fold'], src=OOF_SQL)})"
_UNP = f"""(SELECT model, repeat, fold, metric, v FROM {FOLD_METRICS_SQL} m
  UNPIVOT (v FOR metric IN (roc_auc, pr_auc, brier, log_loss)))"""
SUMMARY_SQL = f"""(SELECT model, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd_across_folds,
  CAST(count(v) AS BIGINT) AS n_folds FROM {_UNP} u GROUP BY model, metric)"""


@q("metrics_by_model_fold", f"SELECT * FROM {FOLD_METRICS_SQL} x")
def metrics_by_model_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fold_metrics(spark, sf)


@q("fold_summary", f"SELECT * FROM {SUMMARY_SQL} s")
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return md.summarise_folds(fold_metrics(spark, sf))


@q("paired_difference", f"""WITH m AS (SELECT * FROM {FOLD_METRICS_SQL} x),
r AS (SELECT repeat, fold, roc_auc AS r_roc, pr_auc AS r_pr FROM m WHERE model = 'fixed_logistic'),
d AS (SELECT m.model, 'roc_auc' AS metric, m.roc_auc - r.r_roc AS d FROM m JOIN r USING (repeat, fold)
      UNION ALL SELECT m.model, 'pr_auc' AS metric, m.pr_auc - r.r_pr AS d FROM m JOIN r USING (repeat, fold))
SELECT model, metric, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS sd_of_differences
FROM d GROUP BY model, metric""")
def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    return md.paired_difference(fold_metrics(spark, sf), "fixed_logistic")


_ORDER_SQL = "[" + ", ".join(f"'{m}'" for m in MODEL_ORDER) + "]"


@q("select_model", f"""WITH s AS (SELECT * FROM {SUMMARY_SQL} x WHERE metric = 'pr_auc' AND model <> 'prior_baseline'),
b AS (SELECT model, mean, coalesce(sd_across_folds, 0.0) AS sd FROM s
      ORDER BY mean DESC, list_position({_ORDER_SQL}, model) LIMIT 1),
sh AS (SELECT mean AS shipped_mean FROM s WHERE model = 'fixed_logistic')
SELECT 'fixed_logistic' AS shipped_model, b.model AS best_by_cv_pr_auc, round(b.mean - sh.shipped_mean, 6)
  AS pr_auc_gap_best_minus_shipped, round(b.sd, 6) AS best_model_pr_auc_sd_across_folds,
  (b.model <> 'fixed_logistic' AND b.mean - sh.shipped_mean > b.sd) AS benchmark_exceeds_shipped_by_more_than_1sd
FROM b, sh""")
def select_model(spark: SparkSession, sf: str) -> DataFrame:
    return md.select_model(md.summarise_folds(fold_metrics(spark, sf)), "fixed_logistic", MODEL_ORDER)


def _leak_sql() -> str:
    pre = sc.fixed_account_model().pre
    parts = []
    for n, src, lvl in pre.encoded:
        x = src if n.startswith("num__") else pre.sql(n)
        parts.append(f"SELECT '{src}' AS feature, corr(CAST({x} AS DOUBLE), CAST(churn AS DOUBLE)) AS r FROM {FEAT} f")
    return (f"SELECT feature, round(max(abs(r)), 6) AS max_abs_corr FROM ({' UNION ALL '.join(parts)}) u "
            "GROUP BY feature")


@q("leakage_scan", _leak_sql())
def leakage_scan(spark: SparkSession, sf: str) -> DataFrame:
    f = pl.account_features(spark, sf, groups=False)
    pre = ft.fit_preprocessor(f)
    enc = pre.transform(f)
    src = {n: s for n, s, _ in pre.encoded}
    return md.leakage_scan(enc, pre.names, lambda c: src[c])


@q("band_report", band_table_sql(
    f"(SELECT CASE WHEN is_test THEN 'holdout' ELSE 'dev' END AS eval_set, churn AS y, risk_score AS p, "
    f"{sq.band_sql('risk_score')} AS rb FROM (SELECT h.*, s.risk_score FROM {HOLDOUT_SQL} h "
    f"JOIN (SELECT customer_id, risk_score FROM {sq.scored_accounts_sql()} z) s USING (customer_id)) q)",
    keys=["eval_set"], band_expr="rb"))
def band_report(spark: SparkSession, sf: str) -> DataFrame:
    sa = sp.holdout_split(pl.scored_accounts(spark, sf), SEED)
    f = sa.select(F.when(F.col("is_test"), "holdout").otherwise("dev").alias("eval_set"),
                  F.col(cs.TARGET).alias("y"), F.col("risk_score").alias("p"), "risk_band")
    return ev.band_table(f, ["eval_set"], band_col="risk_band")


# -- training (rows-only checks; tests hold them against numpy) -------------------------------------

def _design(spark: SparkSession, sf: str) -> dz.Design:
    return dz.design(pl.account_features(spark, sf), K, R, SEED)


@q("lr_cv")
def lr_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of the shipped logistic regression (5 x 3 grouped CV on dev rows)."""
    d = _design(spark, sf)
    fits = dz.cv_fits("logistic_regression", ft.DEFAULT_SPEC, K, R)
    return kl.predictions(d, fits, kl.fit_all(d, fits)).select(F.col("repeat").cast("bigint").alias("repeat"), F.col("fold").cast("bigint").alias("fold"), cs.CLEAN_ID, "y", "p")


@q("lr_holdout")
def lr_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout predictions of the logistic regression fitted on all dev rows."""
    d = _design(spark, sf)
    fits = [dz.Fit("logistic_regression", ft.DEFAULT_SPEC)]
    return kl.predictions(d, fits, kl.fit_all(d, fits)).select(cs.CLEAN_ID, "y", "p")


@q("rf_holdout")
def rf_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout predictions of the random forest (300 trees, depth 20) fitted on all dev rows."""
    f = sp.holdout_split(pl.account_features(spark, sf), SEED)
    model = md.fit("random_forest", f.where(~F.col("is_test")).drop("is_test"))
    return md.predict(model, f.where(F.col("is_test")).drop("is_test"), (cs.CLEAN_ID, F.col(cs.TARGET).alias("y")))


@q("gbt_holdout")
def gbt_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Holdout predictions of the histogram boosting (200 rounds) fitted on all dev rows."""
    d = _design(spark, sf)
    fits = [dz.Fit("gradient_boosting", ft.DEFAULT_SPEC)]
    return kb.predictions(d, fits, kb.fit_boosted(d, fits)).select(cs.CLEAN_ID, "y", "p")


@q("ablations")
def ablations(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression CV per feature-spec variant on identical folds: summary + paired diffs."""
    d = _design(spark, sf)
    fits = [f for label, spec in tf.ablation_specs().items() for f in dz.cv_fits(label, spec, K, R)]
    fm = stored(ev.ranking_metrics(kl.predictions(d, fits, kl.fit_all(d, fits)), ["model", "repeat", "fold"]), "fold-metrics")
    return md.summarise_folds(fm).join(md.paired_difference(fm, "default"), ["model", "metric"], "left")


@q("train_report")
def train_report(spark: SparkSession, sf: str) -> DataFrame:
    """The train flow on all accounts: three candidates, CV, holdout, selection, ablations, final refit."""
    return tf.report(tf.train(pl.account_features(spark, sf)))


def _shipped_run(spark: SparkSession, sf: str) -> tuple[tf.TrainRun, DataFrame]:
    cleaned = pl.cleaned_accounts(spark, sf)
    return tf.train(ft.derive_features(cleaned), ("logistic_regression",), ablations=False), cleaned


@q("full_audit")
def full_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Four attributes with their roles on out-of-fold and holdout predictions of the trained model: points
    and 95% intervals of 500 exact resamples."""
    return tf.audit(*_shipped_run(spark, sf))[0]


@q("full_audit_differences")
def full_audit_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between the values of each audited attribute, with intervals and ``ci_excludes_zero``."""
    return tf.audit(*_shipped_run(spark, sf))[1]
