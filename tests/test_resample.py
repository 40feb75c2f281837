"""The exact bootstrap: draws, metric parts and intervals against brute force."""

from __future__ import annotations

import numpy as np

from churnlens.operators import audit as au
from churnlens.operators import resample as rs

THR = {"best_f1": 0.31, "high_band": 0.5}


def _long(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    p = np.round(rng.beta(2, 4, n), 2)
    y = (rng.random(n) < p).astype(int)
    g = rng.choice(["x", "y", "z"], n, p=[0.5, 0.45, 0.05])
    rows = [("dev", "a", str(v), int(t), float(s)) for v, t, s in zip(g, y, p, strict=True)]
    return rows, spark.createDataFrame(rows, "eval_set string, attribute string, value string, y int, p double").repartition(3)


def brute_metrics(p, pos, neg):
    """Of one replicate, from scores with weights, by their definitions."""
    n, P, N = (pos + neg).sum(), pos.sum(), neg.sum()
    auc = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for s, a in zip(p, pos, strict=True) for t, b in zip(p, neg, strict=True)) / (P * N)
    above = [(pos[p >= s].sum(), (pos + neg)[p >= s].sum()) for s in p]
    ap = sum(a * tp / max(m, 1) for a, (tp, m) in zip(pos, above, strict=True)) / P
    out = {"observed_churn_rate": P / n, "mean_predicted_risk": ((pos + neg) * p).sum() / n, "roc_auc": auc, "pr_auc": ap}
    out["calibration_gap"] = out["mean_predicted_risk"] - out["observed_churn_rate"]
    for name, t in THR.items():
        f, tp = (pos + neg)[p >= t].sum(), pos[p >= t].sum()
        out |= {f"selection_rate_at_{name}": f / n, f"tpr_at_{name}": tp / P, f"fpr_at_{name}": (f - tp) / N, f"precision_at_{name}": tp / f if f else np.nan}
    return out


def test_replicates_equal_brute_force(spark):
    rows, long = _long(spark)
    n_boot, seed = 6, 9
    got = {(r.grp, r.replicate, r.metric): r.value for r in rs.replicate_metrics(long, THR, n_boot, seed).collect()}
    ok = [r.value for r in au.sufficiency(long).collect() if r.status == "ok"]
    assert {k[0] for k in got} == set(ok) and ok
    for value in ok:
        own = [(y, p) for *_, v, y, p in rows if v == value]
        cells = {p: np.array([sum(y for y, q in own if q == p), sum(1 - y for y, q in own if q == p)]) for _, p in own}
        p = np.array(sorted(cells, reverse=True))
        part = np.minimum((p * rs.SLICES).astype(int), rs.SLICES - 1)
        count = np.array([cells[s] for s in p])
        parts = sorted(set(part), reverse=True)
        group = ["dev", "a", value]
        pos_n, neg_n = rs.draw_ranges(*[np.array([count[part == k, j].sum() for k in parts]) for j in (0, 1)], n_boot, seed, group)
        pos, neg = np.zeros((n_boot, len(p)), int), np.zeros((n_boot, len(p)), int)
        for i, k in enumerate(parts):
            at = part == k
            for into, total, j in ((pos, pos_n, 0), (neg, neg_n, 1)):
                if count[at, j].any():
                    into[:, at] = rs.draw_cells(total[:, i], count[at, j], seed, group, k, 1 - j)
        assert (pos.sum(1) + neg.sum(1) == len(own)).all()
        for b in range(n_boot):
            for m, v in brute_metrics(p, pos[b], neg[b]).items():
                have = got[value, b, m]
                assert (np.isnan(v) and (have is None or np.isnan(have))) or abs(have - v) < 1e-9, (value, b, m)


def test_draws_are_multinomial_at_any_size():
    cells = np.array([3, 10, 11, 2_000_000_000])
    total = np.full(4000, cells.sum())
    w = rs.draw_cells(total, cells, 1, ["g"], 0, 1)
    assert (w.sum(1) == cells.sum()).all()
    q = cells / cells.sum()
    assert np.all(np.abs(w.mean(0) - cells) < 5 * np.sqrt(cells * (1 - q) / 4000) + 1e-9)
    assert np.all(np.abs(w[:, :3].var(0) / cells[:3] - 1) < 0.2)
    assert (w == rs.draw_cells(total, cells, 1, ["g"], 0, 1)).all()


def test_intervals_and_spread(spark):
    _, long = _long(spark, 900, 6)
    rep = rs.replicate_metrics(long, THR, 400, 3)
    pdf = rep.toPandas()
    ci = {(r.grp, r.metric): (r.ci_low, r.ci_high) for r in au.intervals(rep, ["eval_set", "attribute", "grp", "metric"], 400).collect()}
    for (g, m), part in pdf.groupby(["grp", "metric"]):
        v = part.value.dropna()
        if len(v) >= 200:
            assert np.allclose(ci[g, m], np.percentile(v, [2.5, 97.5]), atol=1e-6)
        else:
            assert ci[g, m] == (None, None)
    x = pdf[(pdf.grp == "x") & (pdf.metric == "observed_churn_rate")].value
    n = long.where("value = 'x'").count()
    rate = long.where("value = 'x'").toPandas().y.mean()
    assert abs(x.std() / np.sqrt(rate * (1 - rate) / n) - 1) < 0.15


def test_planted_gap_is_found_and_no_gap_is_not(spark):
    rng = np.random.default_rng(2)
    rows = []
    for attribute, shift in (("same", 0.0), ("gap", 0.25)):
        for value in ("a", "b"):
            p = np.round(rng.uniform(0.2, 0.6, 400), 3)
            y = rng.random(400) < p + (shift if value == "b" else 0)
            rows += [("dev", attribute, value, int(t), float(s)) for s, t in zip(p, y, strict=True)]
    long = spark.createDataFrame(rows, "eval_set string, attribute string, value string, y int, p double")
    d = au.differences(au.group_metrics(long, THR), rs.replicate_metrics(long, THR, 200, 5), THR, 200).where("metric = 'observed_churn_rate'")
    found = {r.attribute: r.ci_excludes_zero for r in d.collect()}
    assert found["gap"] and not found["same"]
