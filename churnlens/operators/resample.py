"""Exact bootstrap of subgroup metrics: multinomial weights by splitting counts.

A resample of a group with n rows gives its cells (distinct score and label) multinomial weights. They
are drawn top down, so each draw is exact at any size and none needs the whole group:

1. Scores are cut into ``SLICES`` ranges. One draw a replicate splits n over the (range, label) pairs of a
   group, at most 2 * SLICES counts.
2. Within a range and label, the count drawn for it is split over its cells by another multinomial draw.

A conditional multinomial is multinomial, so both together are one draw over all cells. After step 1 the
positives and negatives above a range are known for every replicate. A task can therefore finish its
range's part of each metric alone (rank sums for AUC, precision at each score for AP, sums at thresholds)
with cells x replicates in numpy; the parts are rows of B numbers and are added up by group. Draws are
seeded by (seed, group, range), so a task that runs again draws the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators import audit as au

SLICES = 256
_PARTS = ("s_pc", "s_pn", "s_ap", "sp")


def _rng(*names) -> np.random.Generator:
    return np.random.default_rng(np.frombuffer(hashlib.sha256("\x1f".join(map(str, names)).encode()).digest(), np.uint32))


def draw_ranges(pos: np.ndarray, neg: np.ndarray, n_boot: int, seed: int, group: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(replicates, ranges) counts of positives and negatives."""
    both = np.concatenate((pos, neg)).astype(np.int64)
    n = int(both.sum())
    drawn = _rng(seed, "ranges", *group).multinomial(n, both / n, n_boot)
    return drawn[:, :len(pos)], drawn[:, len(pos):]


def draw_cells(total: np.ndarray, cells: np.ndarray, seed: int, group: Sequence[str], part: int, label: int) -> np.ndarray:
    """(replicates, cells): ``total`` of each replicate split over the cells."""
    if not len(cells):
        return np.zeros((len(total), 0), np.int64)
    return _rng(seed, "cells", part, label, *group).multinomial(total, cells / cells.sum())


def part_sums(p: np.ndarray, pos: np.ndarray, neg: np.ndarray, pos_above: np.ndarray, neg_above: np.ndarray, cuts: Sequence[float]) -> dict[str, np.ndarray]:
    """A range's part of the metrics, a number a replicate. ``p`` descends; weights are (replicates, scores)."""
    cpos, cneg = np.cumsum(pos, 1) + pos_above[:, None], np.cumsum(neg, 1) + neg_above[:, None]
    out = {"s_pc": (pos * cneg).sum(1), "s_pn": (pos * neg).sum(1), "s_ap": (pos * cpos / np.maximum(cpos + cneg, 1)).sum(1), "sp": (pos + neg) @ p}
    for k, t in enumerate(cuts):
        out[f"f{k}"], out[f"tp{k}"] = (pos + neg)[:, p >= t].sum(1), pos[:, p >= t].sum(1)
    return {k: v.astype(float) for k, v in out.items()}


def metrics_of(s: dict[str, np.ndarray], thresholds: dict[str, float]) -> dict[str, np.ndarray]:
    """The audit's metrics of each replicate; undefined ones are NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        n, pos = s["n"], s["pos"]
        neg = n - pos
        out = {"observed_churn_rate": pos / n, "mean_predicted_risk": s["sp"] / n, "calibration_gap": s["sp"] / n - pos / n,
               "roc_auc": (pos * neg - s["s_pc"] + 0.5 * s["s_pn"]) / (pos * neg), "pr_auc": np.where(neg > 0, s["s_ap"] / pos, np.nan)}
        for k, name in enumerate(thresholds):
            f, tp = s[f"f{k}"], s[f"tp{k}"]
            out |= {f"selection_rate_at_{name}": f / n, f"tpr_at_{name}": tp / pos, f"fpr_at_{name}": (f - tp) / neg, f"precision_at_{name}": tp / f}
    return {k: np.where(np.isfinite(v), v, np.nan) for k, v in out.items()}


def replicate_metrics(long: DataFrame, thresholds: dict[str, float], n_boot: int, seed: int, keys: Sequence[str] = au.GROUP) -> DataFrame:
    """(keys with ``value`` as ``grp``, replicate, metric, value) of the groups with enough data."""
    keys = list(keys)
    cuts = list(thresholds.values())
    ok = au.sufficiency(long, keys).where("status = 'ok'").select(*keys)
    part = F.least(F.floor(F.col("p") * SLICES), F.lit(SLICES - 1)).cast("int")
    # scores, not rows, meet the list of groups: the join deals its input by group
    counted = long.groupBy(*keys, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    scores = counted.join(ok, keys, "left_semi").withColumn("part", part)
    head = ", ".join(f"`{k}` string" for k in keys)
    ranges = scores.groupBy(*keys, "part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        """All ranges of a group, at most SLICES rows."""
        pdf = pdf.sort_values("part", ascending=False)
        pos, neg = draw_ranges(pdf["pos"].to_numpy(), pdf["neg"].to_numpy(), n_boot, seed, [str(pdf[k].iloc[0]) for k in keys])
        above = [np.cumsum(x, 1) - x for x in (pos, neg)]
        return pdf[[*keys, "part"]].assign(**{c: [r.tolist() for r in x.T] for c, x in zip(("pos_n", "neg_n", "pos_above", "neg_above"), (pos, neg, *above), strict=True)})

    drawn = ranges.groupBy(*keys).applyInPandas(split, f"{head}, part int, pos_n array<long>, neg_n array<long>, pos_above array<long>, neg_above array<long>")
    names = [*_PARTS, *[f"{x}{k}" for k in range(len(cuts)) for x in ("f", "tp")]]

    def finish(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """One range of a group: its cells with the counts drawn for it."""
        own = own.sort_values("p", ascending=False)
        group, r = [str(v) for v in key[:-1]], got.iloc[0]
        pos = draw_cells(np.array(r["pos_n"]), own["pos"].to_numpy(), seed, group, int(key[-1]), 1) if own["pos"].any() else np.zeros((n_boot, len(own)), np.int64)
        neg = draw_cells(np.array(r["neg_n"]), own["neg"].to_numpy(), seed, group, int(key[-1]), 0) if own["neg"].any() else np.zeros((n_boot, len(own)), np.int64)
        sums = part_sums(own["p"].to_numpy(), pos, neg, np.array(r["pos_above"]), np.array(r["neg_above"]), cuts)
        row = dict(zip([*keys, "part"], key, strict=True)) | {c: [v.tolist()] for c, v in sums.items()}
        return pd.DataFrame(row | {"n": [(pos + neg).sum(1).astype(float).tolist()], "pos": [pos.sum(1).astype(float).tolist()]})

    sums_schema = f"{head}, part int, " + ", ".join(f"{c} array<double>" for c in [*names, "n", "pos"])
    parts = scores.groupBy(*keys, "part").cogroup(drawn.groupBy(*keys, "part")).applyInPandas(finish, sums_schema)
    by = [F.col(k).alias("grp" if k == "value" else k) for k in keys]
    out = ["grp" if k == "value" else k for k in keys]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        """The parts of a group, at most SLICES rows."""
        sums = {c: np.sum(np.stack(pdf[c].to_numpy()), 0) for c in [*names, "n", "pos"]}
        found = metrics_of(sums, thresholds)
        rows = [pd.DataFrame({"replicate": np.arange(n_boot), "metric": m, "value": v}) for m, v in found.items()]
        return pd.concat(rows).assign(**{k: pdf[k].iloc[0] for k in out})[[*out, "replicate", "metric", "value"]]

    schema = ", ".join(f"`{k}` string" for k in out) + ", replicate int, metric string, value double"
    return parts.select(*by, *names, "n", "pos").groupBy(*out).applyInPandas(total, schema)
