"""The train flow: folds -> all fits -> out-of-fold and holdout predictions -> report, audit, final model.

Every fit of the run reads one stored design table; the predictions of all candidates are one stored
table, and every figure of the report is an aggregate of it. The report is long (section, model, item,
metric, value, note); undefined values are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import audit as au
from churnlens.operators import design as dz
from churnlens.operators import evaluate as ev
from churnlens.operators import keyed_boost as kb
from churnlens.operators import keyed_logit as kl
from churnlens.operators import models as md
from churnlens.operators import resample as rs
from churnlens.operators.features import DEFAULT_SPEC, FeatureSpec, Preprocessor
from churnlens.operators.scoring import LinearModel
from churnlens.session import stored

CANDIDATES = ("prior_baseline", "logistic_regression", "gradient_boosting")
REPORT = "section string, model string, item string, metric string, value double, note string"


def ablation_specs(spec: FeatureSpec = DEFAULT_SPEC) -> dict[str, FeatureSpec]:
    return {"default": spec, "with_protected_attributes": spec.with_protected(), "without_contract": spec.without("contract"),
            "without_total_charges": spec.without("total_charges"), "without_contract_and_total_charges": spec.without("contract", "total_charges")}


@dataclass
class TrainRun:
    design: dz.Design
    spec: FeatureSpec
    shipped: str
    predictions: DataFrame  # model, repeat, fold, customer_id, y, p; repeat -1 is the holdout
    ablations: DataFrame | None  # the same for the shipped model's variants
    final: LinearModel
    best_f1: float

    @property
    def models(self) -> list[str]:
        return [r.model for r in self.predictions.select("model").distinct().orderBy("model").collect()]

    def oof(self) -> DataFrame:
        """(model, customer_id, y, p): the mean over repeats of each dev row."""
        return oof_by_model(self.predictions)

    def holdout(self) -> DataFrame:
        return self.predictions.where("repeat = -1").select("model", cs.CLEAN_ID, "y", "p")


def oof_by_model(predictions: DataFrame) -> DataFrame:
    return predictions.where("repeat >= 0").groupBy("model", cs.CLEAN_ID).agg(F.first("y").alias("y"), F.avg("p").alias("p"))


def _prior(design: dz.Design, fits: list[dz.Fit]) -> list[LinearModel]:
    """Models without inputs whose intercept is the log-odds of the training share."""
    none = FeatureSpec(())
    return [LinearModel(Preprocessor(none, {}, {}, {}), {}, float(s), name=f.model) for f, s in zip(fits, kb.log_odds(design, fits), strict=True)]


def complete(predictions: DataFrame, design: dz.Design) -> None:
    """Every dev row is predicted once a repeat and every holdout row once, by each model."""
    size = {r.is_test: r.n for r in design.table.groupBy("is_test").agg(F.count("*").alias("n")).collect()}
    seen = predictions.groupBy("model", "repeat").agg(F.count("*").alias("n"), F.count_distinct(cs.CLEAN_ID).alias("ids")).collect()
    for r in seen:
        if not r.n == r.ids == size.get(r.repeat < 0, 0):
            raise RuntimeError(f"{r.model}, repeat {r.repeat}: {r.n} predictions of {r.ids} customers, expected {size.get(r.repeat < 0, 0)}")


def train(features: DataFrame, candidates: Sequence[str] = CANDIDATES, shipped: str = md.SHIPPED_MODEL, spec: FeatureSpec = DEFAULT_SPEC,
          seed: int = cs.SEED, n_splits: int = 5, n_repeats: int = 3, ablations: bool = True, rounds: int = kb.ROUNDS) -> TrainRun:
    unknown = set(candidates) - set(CANDIDATES)
    if unknown:
        raise KeyError(f"unknown models {sorted(unknown)}; choose from {sorted(CANDIDATES)}")
    if shipped not in candidates or shipped != "logistic_regression":
        raise ValueError("the shipped model must be among the candidates and have exact contributions")
    d = dz.design(features, n_splits, n_repeats, seed, spec)

    def all_fits(name: str) -> list[dz.Fit]:
        return [*dz.cv_fits(name, spec, n_splits, n_repeats), dz.Fit(name, spec)]

    variants = [f for name, s in ablation_specs(spec).items() if ablations and name != "default" for f in dz.cv_fits(name, s, n_splits, n_repeats)]
    logit = [*all_fits(shipped), *variants, dz.Fit(shipped, spec, everything=True)]
    fitted = kl.fit_all(d, logit)
    both = stored(kl.predictions(d, logit, fitted), "logit-predictions")
    parts = [both.where(F.col("model") == shipped)]
    if "prior_baseline" in candidates:
        fits = all_fits("prior_baseline")
        parts.append(kl.predictions(d, fits, _prior(d, fits)))
    if "gradient_boosting" in candidates:
        fits = all_fits("gradient_boosting")
        parts.append(kb.predictions(d, fits, kb.fit_boosted(d, fits, rounds)))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    made = stored(made, "predictions")
    complete(made, d)
    variant_rows = None
    if ablations:
        variant_rows = both.where(F.col("model") != shipped).unionByName(both.where((F.col("model") == shipped) & (F.col("repeat") >= 0)).withColumn("model", F.lit("default")))
        complete(variant_rows, d)
    best = ev.best_f1_threshold(oof_by_model(made).where(F.col("model") == shipped)).first()
    return TrainRun(d, spec, shipped, made, variant_rows, fitted[-1], float(best["best_f1_threshold"]))


# -- report --------------------------------------------------------------------------------------

def _long(df: DataFrame, section: str, values: Sequence[str], item: Column | str = "", model: Column | str = "") -> DataFrame:
    """Unpivot the columns ``values`` of ``df`` to report rows."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    cells = F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    return df.select(F.lit(section).alias("section"), c(model).cast("string").alias("model"), c(item).cast("string").alias("item"), cells).withColumn("note", F.lit(None).cast("string"))


def report(run: TrainRun) -> DataFrame:
    """The report of a run, one row a figure."""
    m, spark = F.col("model"), run.design.table.sparkSession
    oof, test = stored(run.oof(), "oof"), run.holdout()
    table = run.design.table
    ranking, at = ("n", *md.FOLD_METRICS), ("precision", "recall", "f1", "false_positive_rate", "selection_rate", "tp", "fp", "fn", "tn")
    folds = stored(ev.ranking_metrics(run.predictions.where("repeat >= 0"), ["model", "repeat", "fold"]), "fold-metrics")
    summary = stored(md.summarise_folds(folds), "summary")
    best = ev.best_f1_threshold(oof, ["model"])
    shipped_oof, shipped_test = oof.where(m == run.shipped).drop("model"), test.where(m == run.shipped).drop("model")
    named = lambda c: F.format_string("%.2f", F.col(c))
    out = [
        _long(table.agg(F.count("*").alias("n_rows"), F.sum("y").alias("n_positive"), F.round(F.avg("y"), 6).alias("prevalence")), "dataset", ("n_rows", "n_positive", "prevalence")),
        _long(table.agg(F.sum(F.when(F.col("is_test"), 0).otherwise(1)).alias("n_dev"), F.sum(F.col("is_test").cast("int")).alias("n_test"),
                        F.round(F.avg(F.when(F.col("is_test"), F.col("y"))), 6).alias("test_prevalence"), F.lit(run.design.n_splits).alias("n_splits"),
                        F.lit(run.design.n_repeats).alias("n_repeats")), "protocol", ("n_dev", "n_test", "test_prevalence", "n_splits", "n_repeats")),
        _long(summary, "cv", ("mean", "sd_across_folds", "n_folds"), F.col("metric"), m),
        _long(ev.ranking_metrics(oof, ["model"]), "oof_mean_prediction", ranking, "ranking", m),
        _long(ev.threshold_table(oof, [0.5], ["model"]), "oof_mean_prediction", at, "at_threshold_0.5", m),
        # grid of all models' thresholds; each model keeps the row of its own
        _long(ev.threshold_table(oof, ev.F1_GRID, ["model"]).join(best.select("model", F.col("best_f1_threshold").alias("threshold")), ["model", "threshold"]),
              "oof_mean_prediction", ("threshold", *at), "at_best_f1_threshold", m),
        _long(ev.ranking_metrics(test, ["model"]), "holdout", ranking, "ranking", m),
        _long(ev.threshold_table(test, [0.5], ["model"]), "holdout", at, "at_threshold_0.5", m),
        _long(ev.threshold_table(shipped_test, [run.best_f1]), "holdout", ("threshold", *at), "at_dev_best_f1_threshold", run.shipped),
        _long(ev.threshold_table(shipped_oof), "threshold_sweep_dev_oof", at, named("threshold"), run.shipped),
        _long(ev.cost_ratio_table(shipped_oof), "cost_ratio_sensitivity_dev_oof", ("threshold", "precision", "recall", "selection_rate"), F.col("assumed_cost_ratio_fn_to_fp").cast("int"), run.shipped),
    ]
    for name, rows, bins in (("dev_oof", shipped_oof, 10), ("holdout", shipped_test, 5)):
        out += [
            _long(ev.calibration_table(rows, [cs.CLEAN_ID], bins), f"calibration_{name}", ("n", "mean_predicted", "observed_rate"), F.col("bin"), run.shipped),
            _long(ev.calibration_summary(rows, [cs.CLEAN_ID], bins), f"calibration_{name}", ("expected_calibration_error", "mean_predicted", "observed_rate"), "all", run.shipped),
            _long(ev.capacity_table(rows, [cs.CLEAN_ID]), f"capacity_{name}", ("customers_contacted", "precision", "recall", "lift_over_base_rate"), named("top_fraction"), run.shipped),
            _long(ev.band_table(rows.withColumn("p", F.round("p", cs.SCORE_DECIMALS))), f"risk_bands_{name}", ("customers", "share_of_customers", "observed_churn_rate"), F.col("band"), run.shipped),
        ]
    if run.ablations is not None:
        fm = stored(ev.ranking_metrics(run.ablations.where("repeat >= 0"), ["model", "repeat", "fold"]), "ablation-metrics")
        out += [_long(md.summarise_folds(fm), "ablations", ("mean", "sd_across_folds", "n_folds"), F.col("metric"), m),
                _long(md.paired_difference(fm, "default"), "ablations", ("mean_difference", "sd_of_differences"), F.col("metric"), m)]
    verdict = md.select_model(summary, run.shipped)
    figures = _long(verdict, "model_selection", ("pr_auc_gap_best_minus_shipped", "best_model_pr_auc_sd_across_folds"), "", run.shipped)
    flag = verdict.select(F.lit("model_selection").alias("section"), F.lit(run.shipped).alias("model"), F.lit("").alias("item"), F.lit("benchmark_exceeds_shipped_by_more_than_1sd").alias("metric"),
                          F.col("benchmark_exceeds_shipped_by_more_than_1sd").cast("double").alias("value"), F.concat(F.lit("best by CV PR-AUC: "), F.col("best_by_cv_pr_auc")).alias("note"))
    final = spark.createDataFrame([("final_model", run.shipped, n, "coefficient", c, "fitted on all rows") for n, c in [("intercept", run.final.intercept), *run.final.coef.items()]], REPORT)
    rows = out[0]
    for part in [*out[1:], figures, flag, final]:
        rows = rows.unionByName(part)
    return rows


# -- audit ---------------------------------------------------------------------------------------

def audit_frame(run: TrainRun, attributes: DataFrame) -> DataFrame:
    """(eval_set, attribute, value, y, p) of the shipped model's out-of-fold and holdout predictions.
    ``attributes`` (the cleaned table) has the customer id and the audited columns; a scored customer
    without them is an error."""
    own = F.col("model") == run.shipped
    sets = run.oof().where(own).select(F.lit("dev_oof").alias("eval_set"), cs.CLEAN_ID, "y", "p").unionByName(
        run.holdout().where(own).select(F.lit("holdout").alias("eval_set"), cs.CLEAN_ID, "y", "p"))
    return au.unpivot(au.attach_attributes(sets, attributes), cs.AUDIT_ATTRIBUTES)


def roles(spec: FeatureSpec) -> dict[str, str]:
    used = set(spec.all)
    out = {}
    for a in cs.AUDIT_ATTRIBUTES:
        if a in cs.PROTECTED_ATTRIBUTES:
            out[a] = "protected: USED in model (ablation)" if a in used else "protected: audit only"
        else:
            out[a] = "sensitive-adjacent: used in model and audited" if a in cs.SENSITIVE_ADJACENT else "audited"
    return out


def audit(run: TrainRun, attributes: DataFrame, n_boot: int = 500, seed: int = cs.SEED) -> tuple[DataFrame, DataFrame]:
    """(groups, differences). Groups: eval_set, attribute, role, used_in_model, value, n, n_churned, status,
    metric, estimate, ci_low, ci_high, one row a metric (one without metric where data do not suffice).
    Differences: eval_set, attribute, metric, group_a, group_b, estimate, ci_low, ci_high, ci_excludes_zero."""
    long = stored(audit_frame(run, attributes), "audit")
    thresholds = {"best_f1": run.best_f1, "high_band": cs.RISK_BAND_CUTOFFS["HIGH"]}
    point = stored(au.group_metrics(long, thresholds), "audit-points")
    replicates = stored(rs.replicate_metrics(long, thresholds, n_boot, seed), "replicates")
    by = ["eval_set", "attribute", "value", "metric"]
    ci = au.intervals(replicates, ["eval_set", "attribute", "grp", "metric"], n_boot).withColumnRenamed("grp", "value")
    est = au.long_metrics(point.where("status = 'ok'"), thresholds, au.GROUP).select("eval_set", "attribute", F.col("grp").alias("value"), "metric", F.col("value").alias("estimate"))
    role, used = roles(run.spec), set(run.spec.all)
    named = F.create_map(*[F.lit(x) for kv in role.items() for x in kv])
    flags = F.create_map(*[F.lit(x) for a in cs.AUDIT_ATTRIBUTES for x in (a, a in used)])
    groups = point.select(*au.GROUP, "n", "n_churned", "status").join(est.join(ci, by, "left"), au.GROUP, "left").select(
        "eval_set", "attribute", named[F.col("attribute")].alias("role"), flags[F.col("attribute")].alias("used_in_model"), "value", "n", "n_churned", "status", "metric", "estimate", "ci_low", "ci_high")
    return groups, au.differences(point, replicates, thresholds, n_boot)
