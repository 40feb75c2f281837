from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from churnlens.operators import audit as au
from churnlens.operators import models as md
from churnlens.operators import splits as sp
from churnlens.plans import pipeline as pl
from churnlens.plans import q_audit as qa
from conftest import SF_CHECK, SF_SMALL


def test_fold_integrity_and_balance(spark):
    f = pl.account_features(spark, SF_CHECK)
    folds = sp.assign_folds(f, 5, 3, 42)
    integ = sp.fold_integrity(folds, sp.holdout_split(f, 42)).first()
    assert (integ.rows_not_once, integ.groups_split, integ.rows_in_both) == (0, 0, 0)
    g = sp.group_folds(f, 5, 3, 42).groupBy("repeat", "fold").count().collect()
    sizes = [r["count"] for r in g]
    assert max(sizes) - min(sizes) <= 2


def test_label_shuffle_is_a_permutation(spark):
    f = pl.account_features(spark, SF_SMALL)
    s = sp.label_shuffle(f)
    assert s.count() == f.count()
    assert s.agg(F.sum("churn_shuffled")).first()[0] == f.agg(F.sum("churn")).first()[0]


def _irls(X, y, C=1.0, iters=50):
    Xb = np.hstack([np.ones((len(X), 1)), X])
    w = np.zeros(Xb.shape[1])
    reg = np.eye(len(w)) / C
    reg[0, 0] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = Xb.T @ (p - y) + reg @ w
        H = Xb.T @ (Xb * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    return w


def test_logistic_matches_l2_optimum(spark):
    f = pl.account_features(spark, SF_SMALL)
    m = md.fit_logistic(f)
    pdf = m.pre.transform(f).select(*m.pre.names, "churn").toPandas()
    w = _irls(pdf[m.pre.names].to_numpy(float), pdf["churn"].to_numpy(float))
    got = np.array([m.intercept] + [m.coef[n] for n in m.pre.names])
    assert np.max(np.abs(got - w)) < 1e-4


def test_audit_sufficiency_and_planted_gap(spark):
    long, thr = qa.long_frame(spark, SF_SMALL)
    g = au.group_metrics(long, thr).collect()
    for r in g:
        if r.status != "ok":
            assert r.roc_auc is None and r.observed_churn_rate is None
    d = au.differences(au.group_metrics(long, thr), None, thr, 0).collect()
    assert all(r.group_a < r.group_b for r in d)
