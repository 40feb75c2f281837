"""Registered queries over the accounts fixtures: IO, contract, cleaning, features, scoring,
explanation and value. Each entry has a Spark callable and (where SQL can express it) the
equivalent DuckDB SQL; column names and rounding agree on both sides."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import clean as cl
from churnlens.operators import contract as ct
from churnlens.operators import explain as ex
from churnlens.operators import features as ft
from churnlens.operators import scoring as sc
from churnlens.operators import value as vl
from churnlens.plans import pipeline as pl
from churnlens.plans import score_flow as flow
from churnlens.plans import sql_fixtures as sq
from churnlens.sources import files as io
from churnlens.sources import fixtures as fx
from churnlens.sources import registry as rg

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


RAW_COLS = ", ".join(cs.RAW_COLUMNS)
A = sq.accounts_sql()
AD = sq.accounts_dirty_sql()
CLEAN = sq.cleaned_sql()
FEAT = sq.features_sql()
SA = sq.scored_accounts_sql()

# -- IO ---------------------------------------------------------------------------------------


@q("scan_raw_text", f"SELECT {RAW_COLS} FROM {A} a")
def scan_raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """accounts written as CSV (text, blanks preserved) and read back with the all-text reader."""
    path = io.write_csv(fx.accounts(spark, sf).drop(fx.ROW), io.scratch(spark, "raw_csv"))
    return io.read_raw_csv(spark, path)


_FP_ROW = " || chr(31) || ".join(f"coalesce({c}, '')" for c in cs.RAW_COLUMNS)


@q("table_fingerprint", f"""SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(CAST(('0x' || substr(md5({_FP_ROW}), 1, 15)) AS BIGINT)::HUGEINT) AS VARCHAR) AS fingerprint
FROM {A} a""")
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return io.table_fingerprint(fx.accounts(spark, sf).drop(fx.ROW), cs.RAW_COLUMNS, algo="md5")


def _version_payload_sql(fp: str) -> str:
    spec = ft.DEFAULT_SPEC.fingerprint()
    return (f"'{{\"dataset\": \"' || {fp} || '\", \"features\": \"{spec}\", \"model\": \"logistic_regression\", "
            f"\"params\": {io.LR_PARAMS_JSON}, \"scope\": \"final refit on all rows\", \"seed\": {cs.SEED}}}'")


@q("model_version", f"""WITH fp AS (
  SELECT CAST(sum(CAST(('0x' || substr(md5({_FP_ROW}), 1, 15)) AS BIGINT)::HUGEINT) AS VARCHAR) AS f FROM {A} a)
SELECT 'churn-lr-' || substr(sha256({_version_payload_sql('f')}), 1, 10) AS model_version FROM fp""")
def model_version(spark: SparkSession, sf: str) -> DataFrame:
    fp = io.table_fingerprint(fx.accounts(spark, sf).drop(fx.ROW), cs.RAW_COLUMNS, algo="md5")
    return io.model_version(fp.select(F.col("fingerprint").alias("dataset")), "logistic_regression",
                            ft.DEFAULT_SPEC.fingerprint())


# -- contract ---------------------------------------------------------------------------------


def _checks_sql(raw: str, require_target: bool = True) -> str:
    p_cols = ", ".join(f"{sq.strip(c)} AS s_{c}" for c in cs.RAW_COLUMNS)
    text_cols = [c for c in cs.RAW_COLUMNS if c != "TotalCharges"]

    def cc(cond: str) -> str:
        return f"CAST(count_if(coalesce({cond}, false)) AS BIGINT)"

    t, m, tot = "t", "m", "tot"
    fin = "(isfinite({x}))"
    conds = {
        "customer_id_missing": "s_customerID = ''",
        "customer_id_format": f"NOT regexp_full_match(customerID, '{cs.ID_PATTERN[1:-1]}') AND s_customerID <> ''",
        "tenure_numeric": f"s_tenure = '' OR NOT coalesce({fin.format(x=t)}, false) OR (coalesce({fin.format(x=t)}, false) AND fmod({t}, 1) <> 0)",
        "tenure_non_negative": f"{t} < 0",
        "tenure_plausible_range": f"{t} > {cs.TENURE_MAX_PLAUSIBLE_MONTHS}",
        "monthly_charges_numeric": f"s_MonthlyCharges = '' OR NOT coalesce({fin.format(x=m)}, false)",
        "monthly_charges_positive": f"{m} <= 0",
        "total_charges_numeric": f"NOT tb AND NOT coalesce({fin.format(x=tot)}, false)",
        "total_charges_non_negative": f"{tot} < 0",
        "senior_citizen_binary": "s_SeniorCitizen NOT IN ('0', '1')",
        "total_charges_blank_with_tenure": f"tb AND NOT coalesce({t} = 0, false)",
        "known_issue_ki1_blank_total_charges": f"tb AND {t} = 0",
        "total_charges_zero_tenure": f"{tot} IS NOT NULL AND {t} = 0 AND {tot} > 0",
        "total_charges_positive_with_tenure": f"{tot} IS NOT NULL AND {t} > 0 AND {tot} = 0",
        "structural_multiple_lines": "(PhoneService = 'No') <> (MultipleLines = 'No phone service')",
        "structural_internet_addons": " OR ".join(
            f"((InternetService = 'No') <> ({c} = 'No internet service'))" for c in cs.INTERNET_ADDONS_RAW),
        "target_label_validity": "Churn NOT IN ('Yes', 'No')",
    }
    usable = f"coalesce({tot} IS NOT NULL AND {t} > 0 AND {m} IS NOT NULL AND {t} * {m} > 0, false)"
    pad = " + ".join(cc(f"{c} <> s_{c}") for c in text_cols)
    blank = " + ".join(cc(f"s_{c} = ''") for c in text_cols)
    dom = " + ".join(
        f"CASE WHEN {cc(f'{c} NOT IN (' + ', '.join(repr(v) for v in vals) + ')')} > 0 THEN 1 ELSE 0 END"
        for c, vals in cs.CATEGORICAL_DOMAINS.items())
    counts = {k: cc(v) for k, v in conds.items()}
    yes_n, no_n = cc("Churn = 'Yes'"), cc("Churn = 'No'")
    counts.update({
        "string_padding": pad, "missing_values": blank, "categorical_domains": dom,
        "target_both_classes": f"CAST((CASE WHEN {yes_n} > 0 THEN 1 ELSE 0 END + CASE WHEN {no_n} > 0 THEN 1 ELSE 0 END) < 2 AS BIGINT)",
        "target_prevalence": cc("Churn = 'Yes'"),
        "known_issue_ki4_total_vs_tenure_x_monthly": cc(usable),
        "total_charges_gross_deviation": cc(f"{usable} AND abs({tot} / ({t} * {m}) - 1.0) > {cs.TOTAL_CHARGES_REL_DEV_WARN}"),
        "known_issue_ki3_contract_within_first_term": cc(
            f"(CASE Contract WHEN 'Month-to-month' THEN 1 WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 END) > 1 AND "
            f"{t} < (CASE Contract WHEN 'Month-to-month' THEN 1 WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 END)"),
        "required_columns": "CAST(0 AS BIGINT)", "unexpected_columns": "CAST(0 AS BIGINT)",
        "non_empty": "CAST(count(*) = 0 AS BIGINT)",
    })
    info = {"target_prevalence", "known_issue_ki4_total_vs_tenure_x_monthly", "known_issue_ki3_contract_within_first_term"}
    fused = ",\n  ".join(f"{v} AS \"{k}\"" for k, v in counts.items())
    non_id = ", ".join(c for c in cs.RAW_COLUMNS if c != cs.RAW_ID)
    rows = []
    for cid, sev, _ in ct.CHECKS:
        if cid == "target_both_classes" and not require_target:
            continue
        src = {"customer_id_unique": "d1.v", "known_issue_ki2_duplicate_rows": "d2.v"}.get(cid, f"f.\"{cid}\"")
        trig = "false" if cid in info else f"{src} > 0"
        cond = "TRUE"
        if cid in ("known_issue_ki4_total_vs_tenure_x_monthly", "total_charges_gross_deviation"):
            cond = 'f."known_issue_ki4_total_vs_tenure_x_monthly" > 0'
        rows.append(f"SELECT {ct.ORD[cid]} AS ord, '{cid}' AS check_id, '{sev}' AS severity, {trig} AS triggered, "
                    f"CAST({src} AS BIGINT) AS count FROM f, d1, d2 WHERE {cond}")
    return f"""WITH r AS (SELECT * FROM {raw} x),
p AS (SELECT *, {num_cols()} FROM (SELECT *, {p_cols} FROM r) y),
f AS (SELECT {fused} FROM p),
d1 AS (SELECT coalesce(sum(CASE WHEN n > 1 AND {sq.strip('customerID')} <> '' THEN n END), 0) AS v
       FROM (SELECT customerID, count(*) AS n FROM r GROUP BY customerID) z),
d2 AS (SELECT coalesce(sum(n - 1), 0) AS v FROM (SELECT count(*) AS n FROM r GROUP BY {non_id}) z)
{' UNION ALL '.join(rows)}"""


def num_cols() -> str:
    return ("TRY_CAST(s_tenure AS DOUBLE) AS t, TRY_CAST(s_MonthlyCharges AS DOUBLE) AS m, "
            "(s_TotalCharges = '') AS tb, CASE WHEN s_TotalCharges <> '' THEN TRY_CAST(s_TotalCharges AS DOUBLE) END AS tot")


def _report(df: DataFrame) -> DataFrame:
    return ct.validate(df, row_key=fx.ROW).report().select("ord", "check_id", "severity", "triggered", "count")


@q("contract_checks", _checks_sql(A))
def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _report(pl.raw_accounts(spark, sf))


@q("contract_checks_dirty", _checks_sql(AD))
def contract_checks_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return _report(pl.raw_accounts(spark, sf, dirty=True))


@q("report_rollup", f"""WITH c AS ({_checks_sql(AD)})
SELECT bool_and(NOT (triggered AND severity = 'ERROR')) AS passed,
  CAST(count_if(triggered AND severity = 'ERROR') AS BIGINT) AS n_errors,
  CAST(count_if(triggered AND severity = 'WARNING') AS BIGINT) AS n_warnings,
  CAST(count(*) AS BIGINT) AS n_checks,
  (SELECT CAST(count(*) AS BIGINT) FROM {AD} z) AS n_rows,
  CAST(21 AS BIGINT) AS n_columns
FROM c""")
def report_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ct.validate(pl.raw_accounts(spark, sf, dirty=True), row_key=fx.ROW).rollup()


@q("ki4_deviation", f"""WITH p AS (SELECT *, {num_cols()} FROM (SELECT *, {sq.strip('tenure')} AS s_tenure,
    {sq.strip('MonthlyCharges')} AS s_MonthlyCharges, {sq.strip('TotalCharges')} AS s_TotalCharges FROM {A} a) y),
d AS (SELECT tot / (t * m) - 1.0 AS rel FROM p WHERE tot IS NOT NULL AND t > 0 AND m IS NOT NULL AND t * m > 0)
SELECT CAST(count(*) AS BIGINT) AS rows_compared,
  round(count_if(abs(rel) <= {cs.TOTAL_CHARGES_REL_DEV_TIGHT}) / count(*), 4) AS share_within_tight_band,
  round(quantile_cont(rel, 0.05), 4) AS rel_dev_p05, round(quantile_cont(rel, 0.5), 4) AS rel_dev_median,
  round(quantile_cont(rel, 0.95), 4) AS rel_dev_p95, round(min(rel), 4) AS rel_dev_min, round(max(rel), 4) AS rel_dev_max
FROM d""")
def ki4_deviation(spark: SparkSession, sf: str) -> DataFrame:
    rep = ct.validate(pl.raw_accounts(spark, sf), row_key=fx.ROW).report()
    d = rep.where(F.col("check_id") == "known_issue_ki4_total_vs_tenure_x_monthly").select(
        F.from_json("details", "rows_compared bigint, share_within_tight_band double, rel_dev_p05 double, "
                    "rel_dev_median double, rel_dev_p95 double, rel_dev_min double, rel_dev_max double").alias("d"))
    return d.select("d.rows_compared", "d.share_within_tight_band", "d.rel_dev_p05", "d.rel_dev_median",
                    "d.rel_dev_p95", "d.rel_dev_min", "d.rel_dev_max")


# -- cleaning ---------------------------------------------------------------------------------

CLEAN_OUT = ", ".join(cs.CLEAN_COLUMNS)


@q("clean_accounts", f"SELECT {CLEAN_OUT} FROM {CLEAN} c")
def clean_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return pl.cleaned_accounts(spark, sf).select(*cs.CLEAN_COLUMNS)


@q("dup_groups", f"""SELECT duplicate_group_id, duplicate_group_size, min(customer_id) AS first_customer_id,
  CAST(min(tenure_months) AS BIGINT) AS tenure_months
FROM {CLEAN} c WHERE duplicate_group_size > 1 GROUP BY duplicate_group_id, duplicate_group_size""")
def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = pl.cleaned_accounts(spark, sf).where(F.col("duplicate_group_size") > 1)
    return c.groupBy("duplicate_group_id", "duplicate_group_size").agg(
        F.min(cs.CLEAN_ID).alias("first_customer_id"), F.min("tenure_months").cast("bigint").alias("tenure_months"))


@q("drop_blank_totals", f"""SELECT customerID AS customer_id, CAST(tenure AS BIGINT) AS tenure,
  CAST(TotalCharges AS DOUBLE) AS total_charges FROM {A} a WHERE TotalCharges <> ' '""")
def drop_blank_totals(spark: SparkSession, sf: str) -> DataFrame:
    d = cl.drop_blank_totals(fx.accounts(spark, sf))
    return d.select(F.col("customerID").alias("customer_id"), F.col("tenure").cast("bigint").alias("tenure"),
                    F.col("TotalCharges").alias("total_charges"))


# -- features ---------------------------------------------------------------------------------

FEAT_COLS = ["customer_id", "tenure_months", "monthly_charges", "total_charges", *cs.YES_NO_BINARY,
             "num_addon_services", "internet_service", "contract", "payment_method", "gender", "senior_citizen",
             "churn", "duplicate_group_id"]


@q("derive_features", f"SELECT {', '.join(FEAT_COLS)} FROM {FEAT} f")
def derive_features(spark: SparkSession, sf: str) -> DataFrame:
    return pl.account_features(spark, sf).select(*FEAT_COLS)


_MR = ["customer_id", *ft.DEFAULT_SPEC.all, "churn", "duplicate_group_id"]


@q("model_ready", f"SELECT {', '.join(_MR)} FROM {FEAT} f")
def model_ready(spark: SparkSession, sf: str) -> DataFrame:
    return ft.model_ready(pl.account_features(spark, sf))


def _std_sql() -> str:
    stats = ", ".join(f"avg({c}::DOUBLE) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}::DOUBLE), 0) = 0 THEN 1.0 "
                      f"ELSE stddev_pop({c}::DOUBLE) END AS s_{c}" for c in ft.DEFAULT_SPEC.numeric)
    cols = ", ".join(f"round(({c}::DOUBLE - m_{c}) / s_{c}, 6) AS z_{c}" for c in ft.DEFAULT_SPEC.numeric)
    return f"WITH f AS (SELECT * FROM {FEAT} x), s AS (SELECT {stats} FROM f) SELECT customer_id, {cols} FROM f, s"


@q("standardise", _std_sql())
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    f = pl.account_features(spark, sf)
    pre = ft.fit_preprocessor(f)
    return f.select(cs.CLEAN_ID, *[F.round(pre.column(f"num__{c}"), 6).alias(f"z_{c}") for c in pre.spec.numeric])


def _onehot_name(src: str, level: str) -> str:
    return "oh_" + src + "_" + "".join(ch if ch.isalnum() else "_" for ch in level).lower()


def _onehot_sql() -> str:
    levels = {
        "internet_service": cs.CATEGORICAL_DOMAINS["InternetService"],
        "contract": cs.CATEGORICAL_DOMAINS["Contract"],
        "payment_method": cs.CATEGORICAL_DOMAINS["PaymentMethod"],
    }
    cols = ", ".join(f"CASE WHEN {c} = '{lv}' THEN 1.0 ELSE 0.0 END AS {_onehot_name(c, lv)}"
                     for c, lvs in levels.items() for lv in sorted(lvs))
    return f"SELECT customer_id, {cols} FROM {FEAT} f"


@q("one_hot_flat", _onehot_sql())
def one_hot_flat(spark: SparkSession, sf: str) -> DataFrame:
    f = pl.account_features(spark, sf)
    pre = ft.fit_preprocessor(f)
    cols = [pre.column(n).alias(_onehot_name(src, lvl)) for n, src, lvl in pre.encoded if n.startswith("cat__")]
    return f.select(cs.CLEAN_ID, *cols)


# -- scoring ----------------------------------------------------------------------------------


@q("risk_scores", f"SELECT customer_id, risk_score FROM {SA} s")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    return sc.predict_scores(pl.account_features(spark, sf, groups=False), sc.fixed_account_model())


@q("risk_bands", f"SELECT risk_band, CAST(count(*) AS BIGINT) AS customers FROM {SA} s GROUP BY risk_band")
def risk_bands(spark: SparkSession, sf: str) -> DataFrame:
    return sc.band_counts(pl.scored_accounts(spark, sf, groups=False))


@q("score_table", f"""SELECT customer_id, risk_score, risk_band, 'fixed-logit-v1' AS model_version,
  false AS in_sample FROM {SA} s""")
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    return sc.score_table(pl.account_features(spark, sf, groups=False), sc.fixed_account_model(), "fixed-logit-v1", in_sample=False)


@q("output_contract", f"""SELECT rule, violations FROM (
  SELECT CAST(count_if(coalesce(length(customer_id), 0) = 0) AS BIGINT) AS a,
         CAST(count_if(NOT coalesce(risk_score >= 0 AND risk_score <= 1, false)) AS BIGINT) AS b,
         CAST(count_if(NOT coalesce(risk_band IN ('LOW', 'MEDIUM', 'HIGH'), false)) AS BIGINT) AS c,
         CAST(0 AS BIGINT) AS d
  FROM {SA} s) x
UNPIVOT (violations FOR rule IN (a AS 'customer_id_non_empty', b AS 'risk_score_in_unit_interval',
  c AS 'risk_band_in_domain', d AS 'model_version_non_empty'))""")
def output_contract(spark: SparkSession, sf: str) -> DataFrame:
    t = sc.score_table(pl.account_features(spark, sf, groups=False), sc.fixed_account_model(), "fixed-logit-v1")
    return sc.output_contract(t)


# -- band report (risk bands vs observed churn per evaluation set) -----------------------------
# (defined in q_eval, which owns the split logic)

# -- explanation ------------------------------------------------------------------------------

_EXPL = ex.LinearExplainer(sc.fixed_account_model(), sc.fixed_reference_profile(sc.fixed_account_model().pre))
_FEATS = list(ft.DEFAULT_SPEC.all)


def _explainer(pre_model: sc.LinearModel | None = None) -> ex.LinearExplainer:
    m = sc.fixed_account_model()
    return ex.LinearExplainer(m, sc.fixed_reference_profile(m.pre))


def _ref_means_sql() -> str:
    pre = sc.fixed_account_model().pre
    cols = ", ".join(f"avg({pre.sql(n)}) AS \"{n}\"" for n in pre.names)
    unp = ", ".join(f"\"{n}\"" for n in pre.names)
    return (f"SELECT encoded_column, round(mean, 6) AS mean FROM (SELECT {cols} FROM {FEAT} f) x "
            f"UNPIVOT (mean FOR encoded_column IN ({unp}))")


@q("reference_means", _ref_means_sql())
def reference_means(spark: SparkSession, sf: str) -> DataFrame:
    r = ex.reference_means(pl.account_features(spark, sf, groups=False), sc.fixed_account_model().pre)
    return r.select("encoded_column", F.round("mean", 6).alias("mean"))


@q("contributions", "SELECT customer_id, " + ", ".join(
    f"round({_EXPL.sql_contribution(f)}, 6) AS {f}" for f in _FEATS) + f" FROM {FEAT} f")
def contributions(spark: SparkSession, sf: str) -> DataFrame:
    c = _explainer().contributions(pl.account_features(spark, sf, groups=False))
    return c.select(cs.CLEAN_ID, *[F.round(f, 6).alias(f) for f in _FEATS])


@q("additivity", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS additive FROM {FEAT} f")
def additivity(spark: SparkSession, sf: str) -> DataFrame:
    g = _explainer().additivity_gap(pl.account_features(spark, sf, groups=False))
    return g.select("n_rows", (F.col("max_abs_gap") <= 1e-9).alias("additive"))


_CONTRIB_CTE = "SELECT customer_id, " + ", ".join(f"{_EXPL.sql_contribution(f)} AS {f}" for f in _FEATS) + f" FROM {FEAT} f"


@q("global_importance", f"""SELECT feature, round(avg(abs(c)), 6) AS mean_abs_contribution,
  round(avg(c), 6) AS mean_signed_contribution
FROM ({_CONTRIB_CTE}) x UNPIVOT (c FOR feature IN ({', '.join(_FEATS)})) GROUP BY feature""")
def global_importance(spark: SparkSession, sf: str) -> DataFrame:
    g = _explainer().global_importance(pl.account_features(spark, sf, groups=False))
    return g.select("feature", F.round("mean_abs_contribution", 6).alias("mean_abs_contribution"),
                    F.round("mean_signed_contribution", 6).alias("mean_signed_contribution"))


@q("top_reasons", f"""SELECT customer_id, CAST(rk AS BIGINT) AS reason_rank, feature, round(c, 6) AS contribution FROM (
  SELECT customer_id, feature, c, row_number() OVER (PARTITION BY customer_id ORDER BY c DESC, feature) AS rk
  FROM ({_CONTRIB_CTE}) x UNPIVOT (c FOR feature IN ({', '.join(_FEATS)})) WHERE c > 1e-12) y WHERE rk <= 3""")
def top_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _explainer().reason_rows(pl.account_features(spark, sf, groups=False), top_k=3)


_REASONS_READ = "array<struct<feature:string,contribution_log_odds:double,causal_claim:boolean>>"


@q("saved_model_scores", f"""WITH x AS ({ORACLE['top_reasons']}), r AS (
  SELECT customer_id, string_agg(feature, ',' ORDER BY reason_rank) AS reasons, CAST(count(*) AS BIGINT) AS n_reasons,
    max(CASE WHEN reason_rank = 1 THEN contribution END) AS first_contribution FROM x GROUP BY customer_id)
SELECT s.customer_id, s.risk_score, s.risk_band, 'fixed-logit-v1' AS model_version, true AS in_sample,
  coalesce(r.reasons, '') AS reasons, coalesce(r.n_reasons, 0) AS n_reasons, r.first_contribution
FROM {SA} s LEFT JOIN r USING (customer_id)""")
def saved_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed model is saved with the accounts named as its training table, loaded and run by the
    scoring flow; the reasons are read back from their JSON text."""
    raw = pl.raw_accounts(spark, sf)
    model = sc.fixed_account_model()
    known = flow.content(raw).first()
    meta = rg.model_metadata(spark, "fixed-logit-v1", model.name, {}, cs.SEED, known.fingerprint, known.n_rows, model.pre.spec,
                             sc.fixed_reference_profile(model.pre)).first().asDict()
    path = rg.save_model(spark, model, meta, io.scratch(spark, "model"))
    flat = sc.records_to_frame(flow.score_saved(raw, path, row_key=fx.ROW))
    read = F.from_json("top_reasons", _REASONS_READ)
    return flat.select(cs.CLEAN_ID, "risk_score", "risk_band", "model_version", "in_sample",
                       F.array_join(F.transform(read, lambda r: r["feature"]), ",").alias("reasons"), F.size(read).cast("bigint").alias("n_reasons"),
                       F.get(read, F.lit(0))["contribution_log_odds"].alias("first_contribution"))


# -- value ------------------------------------------------------------------------------------

VALUE_SQL = f"""(SELECT customer_id, risk_score, risk_band, monthly_charges AS monthly_revenue,
  total_charges AS revenue_to_date, round(risk_score * monthly_charges, 4) AS revenue_at_risk_monthly,
  round(monthly_charges * 12.0, 4) AS clv_proxy, round(risk_score * monthly_charges * 12.0, 4) AS clv_at_risk_proxy
FROM {SA} s)"""


@q("value_table", f"SELECT * FROM {VALUE_SQL} v")
def value_table(spark: SparkSession, sf: str) -> DataFrame:
    return pl.value_frame(spark, sf)


@q("aligned_join_check", f"""SELECT CAST(count(*) AS BIGINT) AS n_cleaned, CAST(count(*) AS BIGINT) AS n_scores,
  CAST(0 AS BIGINT) AS unmatched_cleaned, CAST(0 AS BIGINT) AS unmatched_scores,
  CAST(count(*) - count(DISTINCT customer_id) AS BIGINT) AS repeated_keys FROM {CLEAN} c""")
def aligned_join_check(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = pl.cleaned_accounts(spark, sf, groups=False)
    scores = sc.predict_scores(ft.derive_features(cleaned), sc.fixed_account_model())
    return vl.alignment_check(cleaned, scores)


BAND_SUMMARY_SQL = f"""WITH v AS (SELECT * FROM {VALUE_SQL} x),
b AS (SELECT * FROM (VALUES ('LOW', 0), ('MEDIUM', 1), ('HIGH', 2)) t(band, band_order)),
g AS (SELECT risk_band, count(*) AS n, sum(monthly_revenue) AS mr, sum(revenue_at_risk_monthly) AS ar FROM v GROUP BY risk_band),
t AS (SELECT sum(ar) AS tot FROM g)
SELECT b.band, CAST(b.band_order AS INTEGER) AS band_order, CAST(coalesce(g.n, 0) AS BIGINT) AS customers,
  round(coalesce(g.mr, 0.0), 2) AS monthly_revenue, round(coalesce(g.ar, 0.0), 2) AS revenue_at_risk_monthly,
  CASE WHEN t.tot <> 0 THEN round(coalesce(g.ar, 0.0) / t.tot, 4) END AS share_of_revenue_at_risk
FROM b LEFT JOIN g ON b.band = g.risk_band, t"""


@q("band_summary", BAND_SUMMARY_SQL)
def band_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pl.band_summary(spark, sf)


@q("churned_revenue", f"""SELECT round(coalesce(sum(CASE WHEN churn = 1 THEN monthly_charges END), 0.0), 2)
  AS observed_monthly_revenue_of_churned_customers, CAST(count_if(churn = 1) AS BIGINT) AS churned_customers FROM {CLEAN} c""")
def churned_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return vl.churned_revenue(pl.cleaned_accounts(spark, sf, groups=False))


@q("top_revenue_at_risk", f"SELECT * FROM {VALUE_SQL} v ORDER BY revenue_at_risk_monthly DESC, customer_id LIMIT 10")
def top_revenue_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return vl.top_revenue_at_risk(pl.value_frame(spark, sf), 10)


def version_payload(dataset_fp: str) -> str:
    return json.dumps({"dataset": dataset_fp, "features": ft.DEFAULT_SPEC.fingerprint(), "model": "logistic_regression",
                       "params": json.loads(io.LR_PARAMS_JSON), "scope": "final refit on all rows", "seed": cs.SEED},
                      sort_keys=True)


def version_of(dataset_fp: str) -> str:
    return "churn-lr-" + hashlib.sha256(version_payload(dataset_fp).encode()).hexdigest()[:10]
