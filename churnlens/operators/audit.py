"""Subgroup performance audit (descriptive; no fairness verdict).

Attributes are unpivoted once (``explode`` of (attribute, value) pairs), then every metric is
keyed by (evaluation set, attribute, value) and computed for all groups in the same jobs.

Bootstrap: rows that share (group, p, y) are interchangeable for every metric, so the data is
compressed to cells ``(group, p, y) -> c`` first. The audit's own bootstrap is ``resample``: exact
multinomial weights, cells x replicates in numpy. ``bootstrap_intervals`` here is the variant that SQL can
repeat: a Poisson(1) weight for each row and replicate from md5 uniforms, summed by cell (one scan, a hash for each row and replicate).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import evaluate as ev

GROUP = ["eval_set", "attribute", "value"]
INSUFFICIENT = (f"insufficient_data (needs >= {cs.MIN_GROUP_SIZE} customers and >= {cs.MIN_CLASS_COUNT} "
                "of each class)")
POINT_METRICS = ("observed_churn_rate", "mean_predicted_risk", "calibration_gap", "roc_auc", "pr_auc")
THRESHOLD_METRICS = ("selection_rate", "tpr", "fpr", "precision")


def metric_names(thresholds: dict[str, float]) -> list[str]:
    return [*POINT_METRICS, *[f"{m}_at_{t}" for t in thresholds for m in THRESHOLD_METRICS]]


def attach_attributes(pred: DataFrame, attrs: DataFrame, key: str = cs.CLEAN_ID,
                      attributes: Sequence[str] = cs.AUDIT_ATTRIBUTES) -> DataFrame:
    """Left join predictions to attributes; raises when any scored row lacks an attribute."""
    j = pred.join(attrs.select(key, *attributes), key, "left")
    missing = j.where(F.greatest(*[F.col(a).isNull().cast("int") for a in attributes]) == 1).limit(1).count()
    if missing:
        raise ValueError("some scored customers have no audit attributes (customer ids do not match)")
    return j


def join_check(pred: DataFrame, attrs: DataFrame, key: str = cs.CLEAN_ID,
               attributes: Sequence[str] = cs.AUDIT_ATTRIBUTES) -> DataFrame:
    j = pred.join(attrs.select(key, *attributes, F.lit(True).alias("_there")), key, "left")
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n_scored"),
                 F.sum(F.col("_there").isNull().cast("int")).cast("bigint").alias("unmatched"),
                 F.sum(F.greatest(*[F.col(a).isNull().cast("int") for a in attributes])).cast("bigint")
                 .alias("missing_attributes"))


def unpivot(df: DataFrame, attributes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
                                for a in attributes])).alias("_a")
    base = df.select("eval_set", "y", "p", *keep, pairs)
    return base.select("eval_set", F.col("_a.attribute").alias("attribute"), F.col("_a.value").alias("value"),
                       "y", "p", *keep)


def _w(df: DataFrame) -> Column:
    return F.col("w").cast("double") if "w" in df.columns else F.lit(1.0)


def _threshold_aggs(df: DataFrame, thresholds: dict[str, float]) -> list[Column]:
    w, y = _w(df), F.col("y").cast("double")
    out = []
    for name, t in thresholds.items():
        flag = (F.col("p") >= F.lit(float(t))).cast("double")
        out += [F.sum(w * flag).alias(f"_f_at_{name}"), F.sum(w * flag * y).alias(f"_tp_at_{name}")]
    return out


def _threshold_cols(thresholds: dict[str, float]) -> list[Column]:
    n, P = F.col("_n"), F.col("_pos")
    N = n - P
    cols = []
    for name in thresholds:
        f, tp = F.col(f"_f_at_{name}"), F.col(f"_tp_at_{name}")
        fp = f - tp
        cols += [
            F.when(n > 0, f / n).alias(f"selection_rate_at_{name}"),
            F.when(P > 0, tp / P).alias(f"tpr_at_{name}"),
            F.when(N > 0, fp / N).alias(f"fpr_at_{name}"),
            F.when(f > 0, tp / f).alias(f"precision_at_{name}"),
        ]
    return cols


def sample_metrics(long: DataFrame, thresholds: dict[str, float], keys: Sequence[str] = GROUP,
                   rounded: bool = True) -> DataFrame:
    """keys, n, n_churned and every audit metric (NaN-free: undefined -> NULL)."""
    keys = list(keys)
    w, y = _w(long), F.col("y").cast("double")
    base = long.groupBy(*keys).agg(
        F.sum(w).alias("_n"), F.sum(w * y).alias("_pos"), F.sum(w * F.col("p")).alias("_sp"),
        *_threshold_aggs(long, thresholds))
    rank = ev.ranking_metrics(long, keys).select(*keys, "roc_auc", "pr_auc")
    j = base.join(rank, keys, "left")
    n = F.col("_n")
    obs, mp = F.when(n > 0, F.col("_pos") / n), F.when(n > 0, F.col("_sp") / n)
    cols = [obs.alias("observed_churn_rate"), mp.alias("mean_predicted_risk"), (mp - obs).alias("calibration_gap"),
            "roc_auc", "pr_auc", *_threshold_cols(thresholds)]
    out = j.select(*keys, n.cast("bigint").alias("n"), F.col("_pos").cast("bigint").alias("n_churned"), *cols)
    if rounded:
        for m in metric_names(thresholds):
            out = out.withColumn(m, F.round(F.col(f"`{m}`"), 6))
    return out


def sufficiency(long: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    keys = list(keys)
    g = long.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                F.sum(F.col("y").cast("bigint")).cast("bigint").alias("n_churned"))
    ok = ((F.col("n") >= cs.MIN_GROUP_SIZE) & (F.col("n_churned") >= cs.MIN_CLASS_COUNT)
          & (F.col("n") - F.col("n_churned") >= cs.MIN_CLASS_COUNT))
    return g.withColumn("status", F.when(ok, "ok").otherwise(INSUFFICIENT))


def group_metrics(long: DataFrame, thresholds: dict[str, float], keys: Sequence[str] = GROUP) -> DataFrame:
    """Per group: n, n_churned, status and point estimates (NULL for insufficient groups)."""
    keys = list(keys)
    s = sufficiency(long, keys)
    m = sample_metrics(long, thresholds, keys).drop("n", "n_churned")
    j = s.join(m, keys, "left")
    ok = F.col("status") == "ok"
    return j.select(*keys, "n", "n_churned", "status",
                    *[F.when(ok, F.col(f"`{c}`")).alias(c) for c in metric_names(thresholds)])


def long_metrics(wide: DataFrame, thresholds: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Unpivot the metric columns: keys (a group column ``value`` becomes ``grp``), metric, value."""
    names = metric_names(thresholds)
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in names])
    return wide.select(*[F.col(k).alias("grp") if k == "value" else F.col(k) for k in keys], F.inline(arr))


# -- bootstrap ---------------------------------------------------------------------------------

def poisson1_cdf_points(kmax: int = 10) -> list[float]:
    out, cdf, pmf = [], 0.0, math.exp(-1.0)
    for k in range(0, kmax + 1):
        cdf += pmf
        out.append(cdf)
        pmf /= (k + 1)
    return out


def _poisson1(h: Column) -> Column:
    """Inverse CDF of Poisson(1) (exact up to k = 10) at the first 8 hex digits of ``h`` over 2^32.
    Lower-case hex of one length sorts as the numbers do, so the digits are compared as they are."""
    expr = None
    for k, cdf in enumerate(poisson1_cdf_points()):
        below = h < F.lit(f"{math.ceil(cdf * 2**32):08x}")  # cdf * 2**32 is exact; all are under 2**32
        expr = F.when(below, k) if expr is None else expr.when(below, k)
    return expr.otherwise(11)


def bootstrap_weights(long: DataFrame, n_boot: int, seed: int, row_key: Sequence[str], keys: Sequence[str] = GROUP) -> DataFrame:
    """keys, replicate, p, y, w: the summed Poisson(1) weights of each cell's rows in each replicate.

    A row carries the hashes of its replicates as columns and the cells one sum a replicate: rows are
    neither repeated nor looked up by replicate. Only the cells are unpivoted."""
    keys = list(keys)
    rk = F.concat_ws(":", *[F.col(k).cast("string") for k in row_key])
    x = long.select("*", rk.alias("_rk"))
    hashed = x.select(*keys, "p", "y", *[
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("attribute"), F.lit(str(b)), F.col("_rk"))).alias(f"_h{b}") for b in range(n_boot)])
    cells = hashed.groupBy(*keys, "p", "y").agg(*[F.sum(_poisson1(F.col(f"_h{b}"))).cast("bigint").alias(f"_w{b}") for b in range(n_boot)])
    return cells.select(*keys, F.posexplode(F.array(*[f"_w{b}" for b in range(n_boot)])).alias("replicate", "w"), "p", "y").select(
        *keys, "replicate", "p", "y", "w")


def bootstrap_intervals(long: DataFrame, thresholds: dict[str, float], n_boot: int, row_key: Sequence[str], seed: int = cs.SEED,
                        keys: Sequence[str] = GROUP) -> tuple[DataFrame, DataFrame]:
    """(replicate metrics in long form, per-group 95% percentile intervals). Only sufficient groups."""
    keys = list(keys)
    ok = sufficiency(long, keys).where(F.col("status") == "ok").select(*keys)
    # only cells meet the list of groups: joined to the rows it would deal them by group, a group a task.
    # Replicate weights are read twice (sums and score histograms): materialise them once; the
    # checkpoint also cuts the lineage back to the raw rows
    wts = bootstrap_weights(long, n_boot, seed, row_key, keys).where(F.col("w") > 0).join(ok, keys, "left_semi").checkpoint(eager=True)
    rep = sample_metrics(wts, thresholds, [*keys, "replicate"], rounded=False)
    rep_long = long_metrics(rep, thresholds, [*keys, "replicate"])
    by = ["grp" if k == "value" else k for k in keys]
    return rep_long, intervals(rep_long, [*by, "metric"], n_boot)


def intervals(rep_long: DataFrame, by: list[str], n_boot: int) -> DataFrame:
    finite = F.when(~F.isnan(F.col("value")), F.col("value"))
    g = rep_long.groupBy(*by).agg(F.count(finite).alias("_nf"),
                                 F.percentile(finite, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    enough = F.col("_nf") >= max(10, int(0.5 * n_boot))
    return g.select(*by, F.when(enough, F.round(F.col("_q")[0], 6)).alias("ci_low"),
                    F.when(enough, F.round(F.col("_q")[1], 6)).alias("ci_high"))


def differences(point: DataFrame, rep_long: DataFrame | None, thresholds: dict[str, float], n_boot: int,
                set_keys: Sequence[str] = ("eval_set", "attribute")) -> DataFrame:
    """For sorted group values a < b of one attribute: b - a of the rounded estimates and the
    percentile interval of replicate-wise differences. These are pairs of subgroup VALUES (a
    handful per attribute), joined on (attribute, metric[, replicate]) - never pairs of rows."""
    sk = list(set_keys)
    lp = long_metrics(point.where(F.col("status") == "ok"), thresholds, [*sk, "value"])
    A, B = lp.alias("A"), lp.alias("B")
    cond = [F.col(f"A.{k}") == F.col(f"B.{k}") for k in [*sk, "metric"]] + [F.col("A.grp") < F.col("B.grp")]
    pairs = A.join(B, cond).where(F.col("A.value").isNotNull() & F.col("B.value").isNotNull()).select(
        *[F.col(f"A.{k}").alias(k) for k in sk], F.col("A.metric").alias("metric"),
        F.col("A.grp").alias("group_a"), F.col("B.grp").alias("group_b"),
        F.round(F.col("B.value") - F.col("A.value"), 6).alias("estimate"))
    if rep_long is None:
        return pairs
    RA, RB = rep_long.alias("RA"), rep_long.alias("RB")
    rc = [F.col(f"RA.{k}") == F.col(f"RB.{k}") for k in [*sk, "metric", "replicate"]] + [F.col("RA.grp") < F.col("RB.grp")]
    d = RA.join(RB, rc).select(*[F.col(f"RA.{k}").alias(k) for k in sk], F.col("RA.metric").alias("metric"),
                               F.col("RA.grp").alias("group_a"), F.col("RB.grp").alias("group_b"),
                               (F.col("RB.value") - F.col("RA.value")).alias("value"))
    ci = intervals(d, [*sk, "metric", "group_a", "group_b"], n_boot)
    out = pairs.join(ci, [*sk, "metric", "group_a", "group_b"], "left")
    excl = F.coalesce(F.col("ci_low").isNotNull() & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)), F.lit(False))
    return out.withColumn("ci_excludes_zero", excl)
