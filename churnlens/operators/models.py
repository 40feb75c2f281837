"""Model training and cross-validation with Spark ML.

* logistic regression: L2, C = 1 (sklearn objective) -> ``regParam = 1 / (C * n_train)``, no
  internal standardisation (the preprocessor scales with the population std), lbfgs. The fitted
  coefficients are copied into a ``LinearModel`` so scoring and explanation are Column expressions.
* random forest: ``forest``, which grows the trees of Spark ML's estimator (an approximate counterpart: binned
  splits, depth cap) in groups of rows. Spark ML's own ships a histogram of every open node from each task.
* the prior baseline predicts the training prevalence.
* gradient boosting is in ``keyed_boost``; ``keyed_logit`` fits all logistic models of a training run
  together, which ``plans.train_flow`` uses.

CV fits are independent Spark jobs over a cached feature frame, run from a small driver thread
pool; out-of-fold predictions are unioned back as a DataFrame and checked for completeness.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators.features import DEFAULT_SPEC, FeatureSpec, fit_preprocessor
from churnlens.operators.forest import ForestModel, fit_forest
from churnlens.operators.scoring import LinearModel

COMPLEXITY_ORDER = ("prior_baseline", "logistic_regression", "gradient_boosting", "random_forest")
SHIPPED_MODEL = "logistic_regression"
FOLD_METRICS = ("roc_auc", "pr_auc", "brier", "log_loss")


def fit_logistic(train: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, C: float = 1.0, max_iter: int = 1000,
                 label: str = cs.TARGET) -> LinearModel:
    pre = fit_preprocessor(train, spec)
    n = train.count()
    stages = pre.ml_stages("features")
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-10, fitIntercept=True)
    model = Pipeline(stages=[*stages, lr]).fit(train.withColumn(label, F.col(label).cast("double")))
    fitted = model.stages[-1]
    coef = dict(zip(pre.names, [float(c) for c in fitted.coefficients], strict=True))
    return LinearModel(pre, coef, float(fitted.intercept), name="logistic_regression")


class TreeModel:
    """A fitted Spark ML tree pipeline; ``predict`` returns P(churn) as a column."""

    def __init__(self, pipeline_model, name: str):
        self.model, self.name = pipeline_model, name

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        out = self.model.transform(df)
        return out.select(*keep, vector_to_array("probability")[1].alias("p"))


def fit_tree(train: DataFrame, kind: str, spec: FeatureSpec = DEFAULT_SPEC, label: str = cs.TARGET,
             seed: int = cs.SEED) -> ForestModel:
    if kind != "random_forest":
        raise KeyError(f"unknown tree model {kind!r}")
    return fit_forest(train, spec, label, seed)


def predict(model, df: DataFrame, keep: Sequence[str] = (cs.CLEAN_ID,)) -> DataFrame:
    if isinstance(model, LinearModel):
        return df.select(*keep, model.probability().alias("p"))
    if isinstance(model, float):
        return df.select(*keep, F.lit(model).alias("p"))
    return model.predict(df, keep)


def fit(name: str, train: DataFrame, spec: FeatureSpec = DEFAULT_SPEC):
    if name == "prior_baseline":
        return float(train.agg(F.avg(F.col(cs.TARGET).cast("double"))).first()[0])
    if name == "logistic_regression":
        return fit_logistic(train, spec)
    return fit_tree(train, name, spec)


def cv_predict(frame: DataFrame, folds: DataFrame, name: str, spec: FeatureSpec = DEFAULT_SPEC,
               n_splits: int = 5, n_repeats: int = 3, threads: int = 8,
               group: str = "duplicate_group_id") -> DataFrame:
    """Out-of-fold predictions (repeat, fold, customer_id, y, p) for every repeat x fold."""
    data = frame.join(folds, group).persist()
    tasks = [(r, k) for r in range(n_repeats) for k in range(n_splits)]

    def one(task: tuple[int, int]) -> DataFrame:
        r, k = task
        part = data.where(F.col("repeat") == r)
        model = fit(name, part.where(F.col("fold") != k), spec)
        val = part.where(F.col("fold") == k)
        pred = predict(model, val, (cs.CLEAN_ID, F.col(cs.TARGET).alias("y")))
        # materialise each fold's predictions so the union does not re-run the fits
        return pred.select(F.lit(r).cast("bigint").alias("repeat"), F.lit(k).cast("bigint").alias("fold"),
                           cs.CLEAN_ID, "y", "p").checkpoint(eager=True)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        parts = list(pool.map(one, tasks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n_rows = frame.count()
    got = out.groupBy("repeat").count().collect()
    if len(got) != n_repeats or any(r["count"] != n_rows for r in got):
        raise RuntimeError("OOF predictions incomplete")
    data.unpersist()
    return out


def oof_mean(oof: DataFrame) -> DataFrame:
    return oof.groupBy(cs.CLEAN_ID).agg(F.first("y").alias("y"), F.avg("p").alias("p_oof"))


def summarise_folds(fold_metrics: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per model and metric: mean, sample SD and number of folds (NULL metrics dropped)."""
    keys = list(keys)
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in FOLD_METRICS])
    long = fold_metrics.select(*keys, F.inline(arr))
    return long.groupBy(*keys, "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd_across_folds"),
        F.count("value").cast("bigint").alias("n_folds"))


def paired_difference(fold_metrics: DataFrame, reference: str, metrics: Sequence[str] = ("roc_auc", "pr_auc"),
                      model_col: str = "model") -> DataFrame:
    """Per model and metric: mean and sample SD of per-fold differences against ``reference``."""
    ref = fold_metrics.where(F.col(model_col) == reference).select(
        "repeat", "fold", *[F.col(m).alias(f"ref_{m}") for m in metrics])
    j = fold_metrics.join(ref, ["repeat", "fold"])
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) - F.col(f"ref_{m}")).alias("d")) for m in metrics])
    long = j.select(model_col, F.inline(arr))
    return long.groupBy(model_col, "metric").agg(F.round(F.avg("d"), 6).alias("mean_difference"),
                                                 F.round(F.stddev_samp("d"), 6).alias("sd_of_differences"))


def select_model(summary: DataFrame, shipped: str = SHIPPED_MODEL,
                 order: Sequence[str] = COMPLEXITY_ORDER) -> DataFrame:
    """Best benchmark by CV PR-AUC mean (ties -> simpler); flags (never switches) when it beats the
    shipped model by more than its own fold SD."""
    pr = summary.where((F.col("metric") == "pr_auc") & (F.col("model") != "prior_baseline"))
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    best = pr.orderBy(F.col("mean").desc(), rank.asc()).limit(1).select(
        F.col("model").alias("best_by_cv_pr_auc"), F.col("mean").alias("best_mean"),
        F.coalesce(F.col("sd_across_folds"), F.lit(0.0)).alias("best_sd"))
    shipped_row = pr.where(F.col("model") == shipped).select(F.col("mean").alias("shipped_mean"))
    s = shipped_row.first()
    shipped_mean = float(s["shipped_mean"]) if s else None
    gap = F.col("best_mean") - F.lit(shipped_mean)
    return best.select(
        F.lit(shipped).alias("shipped_model"), "best_by_cv_pr_auc", F.round(gap, 6).alias("pr_auc_gap_best_minus_shipped"),
        F.round(F.col("best_sd"), 6).alias("best_model_pr_auc_sd_across_folds"),
        ((F.col("best_by_cv_pr_auc") != shipped) & (gap > F.col("best_sd"))).alias(
            "benchmark_exceeds_shipped_by_more_than_1sd"))


def leakage_scan(encoded: DataFrame, columns: Sequence[str], source: Callable[[str], str],
                 label: str = cs.TARGET) -> DataFrame:
    """Max |Pearson correlation| of each encoded input with the label, per source feature."""
    agg = encoded.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    arr = F.array(*[F.struct(F.lit(source(c)).alias("feature"), F.col(f"`{c}`").alias("r")) for c in columns])
    long = agg.select(F.inline(arr))
    return long.groupBy("feature").agg(F.round(F.max(F.abs(F.col("r"))), 6).alias("max_abs_corr"))
