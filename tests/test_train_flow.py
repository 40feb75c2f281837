"""The train flow against numpy: logistic optima, boosted trees, completeness, report and audit figures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import design as dz
from churnlens.operators import keyed_boost as kb
from churnlens.operators import keyed_logit as kl
from churnlens.operators.features import DEFAULT_SPEC
from churnlens.plans import pipeline as pl
from churnlens.plans import train_flow as tf
from churnlens.session import stored
from conftest import SF_SMALL
from test_splits_models_audit import _irls


@pytest.fixture(scope="module")
def cleaned(spark):
    return stored(pl.cleaned_accounts(spark, SF_SMALL), "cleaned")


@pytest.fixture(scope="module")
def run(cleaned):
    from churnlens.operators import features as ft
    return tf.train(ft.derive_features(cleaned), n_repeats=2, rounds=12)


def _train_frame(run, fit):
    pdf = run.design.table.toPandas()
    folds = np.stack(pdf["folds"].to_numpy())
    mine = dz.training_rows([fit], pdf["is_test"].to_numpy(), folds)[:, 0]
    x = np.stack(pdf["x"].to_numpy())
    return x[mine], pdf["y"].to_numpy(float)[mine], x, pdf


@pytest.mark.parametrize("fit", [dz.Fit("m", DEFAULT_SPEC, everything=True), dz.Fit("m", DEFAULT_SPEC.with_protected(), 1, 3), dz.Fit("m", DEFAULT_SPEC.without("contract", "total_charges"), 0, 0)])
def test_logistic_fits_are_the_optimum(run, fit):
    model = kl.fit_all(run.design, [fit])[0]
    x, y, _, _ = _train_frame(run, fit)
    cols = run.design.columns(fit.spec)
    z = x[:, cols].copy()
    k = len(fit.spec.numeric)
    z[:, :k] = (z[:, :k] - z[:, :k].mean(0)) / z[:, :k].std(0)
    w = _irls(z, y)
    got = np.array([model.intercept, *[model.coef[n] for n in model.pre.names]])
    assert np.max(np.abs(got - w)) < 1e-6


def test_scoring_column_equals_stored_coefficients(run):
    p = run.design.table
    a = np.array(kl.stored_coefficients(run.design, run.final))
    x = np.stack([r.x for r in p.select("x").collect()])
    means, stds = run.design.base.means, run.design.base.stds
    z = run.final.intercept + sum(run.final.coef[n] * ((x[:, at] * stds[src] + means[src] - run.final.pre.means[src]) / run.final.pre.stds[src] if src in DEFAULT_SPEC.numeric else x[:, at])
                                  for at, (n, src, _) in zip(run.design.columns(run.spec), run.final.pre.encoded, strict=True))
    assert np.allclose(x @ a, z, atol=1e-9)


def _boost_numpy(bins, y, columns, sizes, rounds):
    """Plain recursive growth, row lists and loops over cuts."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows, depth, g=g, h=h):
            top = None
            if depth < kb.DEPTH:
                for c in columns:
                    for cut in range(sizes[c] - 1):
                        left = rows[bins[rows, c] <= cut]
                        right = rows[bins[rows, c] > cut]
                        if min(len(left), len(right)) < kb.MIN_LEAF or min(h[left].sum(), h[right].sum()) < kb.MIN_HESSIAN:
                            continue
                        gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + kb.L2) for s, r in ((1, left), (1, right), (-1, rows)))
                        if gain > 1e-9 and (top is None or gain > top[0] + 1e-9 * max(gain, 1)):
                            top = (gain, c, cut, left, right)
            if top is None:
                return -kb.RATE * g[rows].sum() / (h[rows].sum() + kb.L2)
            return top[1], top[2], grow(top[3], depth + 1), grow(top[4], depth + 1)

        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        raw = raw + np.array([_walk(tree, b) for b in bins])
    return trees


def _walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def test_boosting_equals_numpy(run, monkeypatch):
    monkeypatch.setattr(kb, "KEEP", 4)  # raw scores are stored twice on the way
    fits = [dz.Fit("b", DEFAULT_SPEC), dz.Fit("b", DEFAULT_SPEC.without("contract"), 1, 2)]
    edges = kb.bin_edges(run.design.table, run.design.width)
    models = kb.fit_boosted(run.design, fits, 10, edges)
    sizes = [len(e) + 1 for e in edges]
    for fit, model in zip(fits, models, strict=True):
        x, y, everyone, _ = _train_frame(run, fit)
        trees = _boost_numpy(kb.bin_rows(x, edges), y, sorted(run.design.columns(fit.spec)), sizes, 10)
        want = np.log(y.mean() / (1 - y.mean())) + np.array([sum(_walk(t, b) for t in trees) for b in kb.bin_rows(everyone, edges)])
        assert np.allclose(model.raw(everyone), want, atol=1e-9)
        assert len(set(np.round(want, 6))) >= 5  # the trees split


def test_boosting_does_not_depend_on_tasks(run, monkeypatch):
    fits = [dz.Fit("b", DEFAULT_SPEC)]
    one = kb.fit_boosted(run.design, fits, 3)[0]
    monkeypatch.setattr(kb, "TASK_ROWS", 10)
    spread = dz.Design(stored(run.design.table.repartition(6), "design"), run.design.base, 5, 2)
    many = kb.fit_boosted(spread, fits, 3)[0]
    x = np.stack([r.x for r in run.design.table.select("x").collect()])
    assert np.allclose(one.raw(x), many.raw(x), atol=1e-9)


def test_bins_of_many_values(spark):
    table = spark.createDataFrame([([1.0, float(k), float(k % 3)],) for k in range(2000)], "x array<double>")
    edges = kb.bin_edges(table, 3, bins=50)
    assert edges[0] == [] and edges[2] == [0.5, 1.5] and 40 <= len(edges[1]) <= 49 and edges[1] == sorted(edges[1])


def test_predictions_are_complete_and_checked(run):
    tf.complete(run.predictions, run.design)
    with pytest.raises(RuntimeError):
        tf.complete(run.predictions.where("not (repeat = 1 and fold = 2)"), run.design)
    oof = run.oof().groupBy("model").count().collect()
    n_dev = run.design.table.where("not is_test").count()
    assert {r.model for r in oof} == set(tf.CANDIDATES) and all(r["count"] == n_dev for r in oof)


def test_report_figures(run):
    rows = {(r.section, r.model, r.item, r.metric): r.value for r in tf.report(run).collect()}
    pdf = run.predictions.where("model = 'logistic_regression' and repeat >= 0").toPandas()
    brier = pdf.assign(b=(pdf.p - pdf.y) ** 2).groupby(["repeat", "fold"]).b.mean()
    assert abs(rows["cv", "logistic_regression", "brier", "mean"] - brier.round(6).mean()) < 2e-6
    assert abs(rows["cv", "logistic_regression", "brier", "sd_across_folds"] - brier.round(6).std(ddof=1)) < 2e-6
    assert rows["cv", "logistic_regression", "brier", "n_folds"] == 10
    y = run.design.table.select("y").toPandas().y
    assert rows["dataset", "", "", "n_rows"] == len(y) and abs(rows["dataset", "", "", "prevalence"] - y.mean()) < 1e-6
    assert rows["final_model", "logistic_regression", "intercept", "coefficient"] == run.final.intercept
    assert abs(rows["ablations", "default", "roc_auc", "mean"] - rows["cv", "logistic_regression", "roc_auc", "mean"]) < 1e-9
    assert rows["ablations", "default", "pr_auc", "mean_difference"] == 0
    assert rows["holdout", "logistic_regression", "at_dev_best_f1_threshold", "threshold"] == run.best_f1
    assert rows["model_selection", "logistic_regression", "", "benchmark_exceeds_shipped_by_more_than_1sd"] in (0, 1)
    assert rows["cv", "prior_baseline", "roc_auc", "mean"] == 0.5


def test_shuffled_labels_give_chance(run):
    table = run.design.table
    shuffled = table.withColumn("y", (F.pmod(F.xxhash64("duplicate_group_id"), F.lit(1000)) < 300).cast("int"))
    d = dz.Design(stored(shuffled, "shuffled"), run.design.base, 5, 2)
    fits = dz.cv_fits("m", DEFAULT_SPEC, 5, 2)
    p = kl.predictions(d, fits, kl.fit_all(d, fits)).groupBy("customer_id").agg(F.first("y").alias("y"), F.avg("p").alias("p")).toPandas()
    pos, neg = p[p.y == 1].p.to_numpy(), p[p.y == 0].p.to_numpy()
    auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert abs(auc - 0.5) < 0.2


def test_audit_joins_real_predictions(run, cleaned):
    groups, differences = tf.audit(run, cleaned, n_boot=40)
    rows = groups.collect()
    pdf = run.oof().where("model = 'logistic_regression'").join(cleaned.select("customer_id", "gender"), "customer_id").toPandas()
    for value, part in pdf.groupby("gender"):
        got = next(r for r in rows if (r.eval_set, r.attribute, r.value, r.metric) == ("dev_oof", "gender", value, "mean_predicted_risk"))
        assert got.n == len(part) and abs(got.estimate - part.p.mean()) < 1e-6 and got.ci_low <= got.estimate <= got.ci_high
    role = {r.attribute: (r.role, r.used_in_model) for r in rows}
    assert role["gender"] == ("protected: audit only", False) and role["partner"] == ("sensitive-adjacent: used in model and audited", True)
    for r in differences.collect():
        assert r.group_a < r.group_b
        assert r.ci_excludes_zero == (r.ci_low is not None and (r.ci_low > 0 or r.ci_high < 0))
    with pytest.raises(ValueError):
        tf.audit_frame(run, cleaned.where("contract <> 'Two year'"))


def test_unknown_candidates(run):
    with pytest.raises(KeyError):
        tf.train(None, ("svm", "logistic_regression"))
    with pytest.raises(ValueError):
        tf.train(None, ("prior_baseline",))
