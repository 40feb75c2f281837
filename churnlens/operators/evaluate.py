"""Evaluation: ranking metrics, threshold analysis, capacity, calibration and band tables.

Input: a frame with ``y`` (0/1), ``p`` (score) and optionally ``w`` (non-negative weight), plus any
grouping ``keys`` (fold, model, evaluation set, subgroup, bootstrap replicate, ...). Every metric
is computed for every key at once.

Physical design:
* **score histogram** ``(keys, p) -> (pos, neg)``: a partial (map-side) aggregate. Scores are
  rounded to 6 dp by the engine, so it holds at most 1,000,001 rows per key whatever the input
  size; hot scores collapse into one row before the shuffle.
* ROC-AUC / average precision need running sums over the score order: ``_running`` sums within
  ``RANGES`` score ranges and adds the totals of the ranges before, so that neither the whole table
  nor a key of very many scores is one window.
* threshold tables: each histogram bucket gets the index of the thresholds it passes
  (a sum of ``p >= t`` comparisons), then a <= (#thresholds+1)-row aggregate per key.
* capacity and calibration cut the score order at exact ranks, ties broken by a row key. The
  histogram's running counts place every score that lies within one segment as a whole; only the
  rows of a score that a cut divides are ranked (``_segments``).
Undefined values (no positives, empty denominators) are NULL, never 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators.ordered import distributed_rank

# FIXED VALUES: threshold grids and table parameters of the evaluation protocol.
SWEEP_THRESHOLDS = tuple(float(round(t, 2)) for t in np.arange(0.10, 0.91, 0.10))
F1_GRID = tuple(float(t) for t in np.round(np.arange(0.05, 0.96, 0.01), 2))
COST_GRID = tuple(float(t) for t in np.round(np.arange(0.02, 0.98, 0.01), 2))
CAPACITY_FRACTIONS = (0.05, 0.10, 0.20, 0.30, 0.50)
ASSUMED_COST_RATIOS = (1, 2, 3, 5, 10)
COST_BASIS = "ASSUMED (sensitivity analysis, not an estimated cost)"

#: score ranges of the running sums: scores of 6 decimals give a range at most 3,907 rows per key
RANGES = 256


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _w(df: DataFrame) -> Column:
    return F.col("w").cast("double") if "w" in df.columns else F.lit(1.0)


def histogram(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, p) -> pos, neg (weighted counts)."""
    w, y = _w(df), F.col("y").cast("double")
    return df.groupBy(*keys, "p").agg(F.sum(w * y).alias("pos"), F.sum(w * (F.lit(1.0) - y)).alias("neg"))


def _running(h: DataFrame, sums: Sequence[str], keys: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Append ``cum_<c>``: inclusive running sums over the scores ``p`` of a histogram, per key.

    A window runs over one (key, score range); the totals of the ranges before it, ``RANGES`` rows
    a key at most, are added. Null keys are a group like any other."""
    keys = list(keys)
    ranged = h.withColumn("_range", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * RANGES))
    side = {k: f"_k{i}" for i, k in enumerate([*keys, "_range"])}
    before = Window.partitionBy(*[side[k] for k in keys] or [F.lit(0)]).orderBy(_direction(side["_range"], descending)).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*[F.col(k).alias(v) for k, v in side.items()]).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*side.values(), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(v)) for k, v in side.items()])
    # without keys the offsets are one row a range
    joined = ranged.join(offsets if keys else F.broadcast(offsets), same)
    within = Window.partitionBy(*keys, "_range").orderBy(_direction("p", descending)).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*h.columns, *[(F.sum(c).over(within) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums])


def _direction(c: str, descending: bool) -> Column:
    return F.col(c).desc() if descending else F.col(c).asc()


def ranking_metrics(df: DataFrame, keys: Sequence[str] = (), hist: DataFrame | None = None) -> DataFrame:
    """keys, n, roc_auc, pr_auc, brier, log_loss (6 dp; AUC/AP NULL unless both classes present)."""
    keys = list(keys)
    h = hist if hist is not None else histogram(df, keys)
    c = _running(h, ["pos", "neg"], keys)
    pos, neg, cpos, cneg = F.col("pos"), F.col("neg"), F.col("cum_pos"), F.col("cum_neg")
    pc = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    agg = c.groupBy(*keys).agg(
        F.sum(pos).alias("P"), F.sum(neg).alias("N"),
        F.sum(pos * cneg).alias("s_pc"), F.sum(pos * neg).alias("s_pn"),
        F.sum(F.when(cpos + cneg > 0, pos * (cpos / (cpos + cneg)))).alias("s_ap"),
        F.sum(pos * F.pow(F.lit(1.0) - F.col("p"), 2) + neg * F.pow(F.col("p"), 2)).alias("b"),
        F.sum(-(pos * F.log(pc) + neg * F.log(F.lit(1.0) - pc))).alias("ll"),
    )
    P, N = F.col("P"), F.col("N")
    both = (P > 0) & (N > 0)
    n = P + N
    # AUC = sum_b pos_b * (neg strictly below b + neg_b / 2) / (P * N); the running sum is descending
    auc = (P * N - F.col("s_pc") + F.lit(0.5) * F.col("s_pn")) / (P * N)
    return agg.select(
        *keys, n.cast("bigint").alias("n"),
        r6(F.when(both, auc)).alias("roc_auc"), r6(F.when(both, F.col("s_ap") / P)).alias("pr_auc"),
        r6(F.when(n > 0, F.col("b") / n)).alias("brier"), r6(F.when(n > 0, F.col("ll") / n)).alias("log_loss"),
    )


def with_totals(df: DataFrame, tot: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-key totals. Without keys the totals are one row: read it (bounded) as literals."""
    if keys:
        return df.join(tot, keys)
    row = tot.first()
    return df.select("*", *[F.lit(row[c]).alias(c) for c in tot.columns])


def _threshold_counts(df: DataFrame, thresholds: Sequence[float], keys: list[str],
                      hist: DataFrame | None = None) -> DataFrame:
    """keys, t_idx, threshold, tp, fp, P, N for every threshold (rows for all thresholds)."""
    thr = sorted(float(t) for t in thresholds)
    # the histogram is bounded (distinct scores per key) and feeds several branches below:
    # materialise it once instead of re-scanning the input for each branch
    h = hist if hist is not None else histogram(df, keys).checkpoint(eager=True)
    arr = F.array(*[F.lit(t) for t in thr])
    # number of thresholds passed (p >= t): a sum of comparisons stays in generated code
    j = sum(((F.col("p") >= F.lit(t)).cast("int") for t in thr), F.lit(0))
    by_j = h.groupBy(*keys, j.alias("j")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # bucket j passes thresholds 0..j-1: expand each of the <= len(thr)+1 rows per key
    flagged = by_j.where(F.col("j") > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("t_idx"),
                                                "pos", "neg")
    fl = flagged.groupBy(*keys, "t_idx").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    tot = by_j.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = tot.select(*keys, "P", "N", F.posexplode(arr).alias("t_idx", "threshold"))
    out = grid.join(fl, [*keys, "t_idx"], "left")
    return out.select(*keys, "t_idx", "threshold", F.coalesce("tp", F.lit(0.0)).alias("tp"),
                      F.coalesce("fp", F.lit(0.0)).alias("fp"), "P", "N")


def _metrics_from_counts(c: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, P, N = F.col("tp"), F.col("fp"), F.col("P"), F.col("N")
    fn, tn = P - tp, N - fp
    precision = r6(F.when(tp + fp != 0, tp / (tp + fp)))
    recall = r6(F.when(P != 0, tp / P))
    out = c.select(
        *keys, "t_idx", r6(F.col("threshold")).alias("threshold"),
        precision.alias("precision"), recall.alias("recall"),
        r6(F.when(fp + tn != 0, fp / (fp + tn))).alias("false_positive_rate"),
        r6(F.when(P + N != 0, (tp + fp) / (P + N))).alias("selection_rate"),
        tn.cast("bigint").alias("tn"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"),
        tp.cast("bigint").alias("tp"),
    )
    pr, rc = F.col("precision"), F.col("recall")
    return out.withColumn("f1", r6(F.when(pr.isNotNull() & rc.isNotNull() & (pr + rc > 0), 2 * pr * rc / (pr + rc))))


def threshold_table(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, keys: Sequence[str] = (),
                    hist: DataFrame | None = None) -> DataFrame:
    keys = list(keys)
    return _metrics_from_counts(_threshold_counts(df, thresholds, keys, hist), keys)


def best_f1_threshold(df: DataFrame, keys: Sequence[str] = (), grid: Sequence[float] = F1_GRID,
                      hist: DataFrame | None = None) -> DataFrame:
    """keys, best_f1_threshold, best_f1: max F1 on the grid, ties -> lowest threshold; the first
    grid point when F1 is undefined everywhere. The window is over <= len(grid) rows per key."""
    keys = list(keys)
    t = threshold_table(df, grid, keys, hist)
    # without keys this window spans the threshold table only (len(grid) rows), never the input
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = t.withColumn("_r", F.row_number().over(
        w.orderBy(F.col("f1").desc_nulls_last(), F.col("threshold").asc())))
    best = ranked.where(F.col("_r") == 1)
    return best.select(*keys, F.when(F.col("f1").isNotNull(), F.col("threshold")).otherwise(F.lit(float(min(grid))))
                       .alias("best_f1_threshold"), F.col("f1").alias("best_f1"))


def cost_ratio_table(df: DataFrame, ratios: Sequence[float] = ASSUMED_COST_RATIOS, keys: Sequence[str] = (),
                     grid: Sequence[float] = COST_GRID, hist: DataFrame | None = None) -> DataFrame:
    """Per ASSUMED cost ratio r: threshold minimising r*FN + FP (ties -> lowest threshold)."""
    keys = list(keys)
    t = threshold_table(df, grid, keys, hist)
    rt = t.select("*", F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio"))
    rt = rt.withColumn("cost", F.col("ratio") * F.col("fn") + F.col("fp"))
    w = Window.partitionBy(*keys, "ratio").orderBy(F.col("cost").asc(), F.col("threshold").asc())
    best = rt.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return best.select(*keys, F.col("ratio").alias("assumed_cost_ratio_fn_to_fp"), F.lit(COST_BASIS).alias("basis"),
                       F.round("threshold", 2).alias("threshold"), "precision", "recall", "selection_rate")


def _segments(df: DataFrame, row_key: Sequence[str], segment: Callable[[Column, Column], Column], keys: list[str], descending: bool) -> DataFrame:
    """keys, seg, n, n_pos, rows, hits, p_sum: sums over each segment of the rows in score order (ties by
    ``row_key``). ``segment`` gives the segment, never falling, of a 0-based rank among n rows; n and
    n_pos are the key's totals.

    A histogram score whose first and last rank share a segment counts as a whole. The others, one at
    most for each cut, are looked up in the table, and their rows alone are ranked."""
    base = df.select(*keys, F.col("y").cast("bigint").alias("y"), "p", *row_key)
    h = base.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("hits")).checkpoint(eager=True)
    tot = h.groupBy(*keys).agg(F.sum("rows").alias("n"), F.sum("hits").alias("n_pos"))
    placed = with_totals(_running(h, ["rows"], keys, descending), tot, keys).withColumn("_first", F.col("cum_rows") - F.col("rows"))
    placed = placed.withColumn("seg", segment(F.col("_first"), F.col("n"))).withColumn("_last", segment(F.col("cum_rows") - 1, F.col("n")))
    whole = placed.where("seg = _last").select(*keys, "seg", "n", "n_pos", "rows", "hits", (F.col("p") * F.col("rows")).alias("p_sum"))
    cut = placed.where("seg <> _last").select(*keys, "p", "_first", "n", "n_pos")
    # without keys the cut scores are fewer than the segments
    ranked = distributed_rank(base.join(cut if keys else F.broadcast(cut), [*keys, "p"]), list(row_key), [*keys, "p"], out="_rank")
    parts = ranked.select(*keys, segment(F.col("_first") + F.col("_rank") - 1, F.col("n")).alias("seg"), "n", "n_pos",
                          F.lit(1).cast("bigint").alias("rows"), F.col("y").alias("hits"), F.col("p").alias("p_sum"))
    return whole.unionByName(parts).groupBy(*keys, "seg").agg(
        F.first("n").alias("n"), F.first("n_pos").alias("n_pos"), *[F.sum(c).alias(c) for c in ("rows", "hits", "p_sum")])


def capacity_table(df: DataFrame, row_key: Sequence[str], fractions: Sequence[float] = CAPACITY_FRACTIONS,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Top fraction by score (ties by ``row_key``): precision, recall and lift of contacting them."""
    keys = list(keys)
    cuts = sorted(float(f) for f in fractions)

    def contacted(f: float, n: Column) -> Column:
        return F.greatest(F.lit(1), F.bround(F.lit(f) * n, 0).cast("bigint"))

    # a row is in segment j when j of the rising cuts end before it
    segs = _segments(df, row_key, lambda r, n: sum(((r >= contacted(f, n)).cast("int") for f in cuts), F.lit(0)), keys, descending=True)
    agg = segs.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("n_pos").alias("n_pos"),
        *[F.sum(F.when(F.col("seg") <= i, F.col("hits")).otherwise(0)).alias(f"h{i}") for i in range(len(cuts))])
    rows = [F.struct(F.lit(f).alias("top_fraction"), contacted(f, F.col("n")).alias("customers_contacted"),
                     F.col(f"h{i}").cast("bigint").alias("hits")) for i, f in enumerate(cuts)]
    ex = agg.select(*keys, "n", "n_pos", F.inline(F.array(*rows)))
    prec = F.col("hits") / F.col("customers_contacted")
    base_rate = F.col("n_pos") / F.col("n")
    return ex.select(
        *keys, r6(F.col("top_fraction")).alias("top_fraction"), "customers_contacted",
        r6(prec).alias("precision"), r6(F.when(F.col("n_pos") > 0, F.col("hits") / F.col("n_pos"))).alias("recall"),
        r6(F.when(base_rate > 0, prec / base_rate)).alias("lift_over_base_rate"),
    )


def _calibration_bins(df: DataFrame, row_key: Sequence[str], n_bins: int, keys: list[str]) -> DataFrame:
    """``_segments`` of equal count by ascending score, the first n mod k bins one row larger."""
    def bin_of(r: Column, n: Column) -> Column:
        q = (n / n_bins).cast("bigint")
        rem = n % n_bins
        large = (q + 1) * rem
        return F.when(r < large, (r / (q + 1)).cast("bigint")).otherwise(rem + ((r - large) / q).cast("bigint"))

    return _segments(df, row_key, bin_of, keys, descending=False)


def calibration_table(df: DataFrame, row_key: Sequence[str], n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins by ascending score (first n mod k bins one larger): n, mean p, observed rate."""
    keys = list(keys)
    g = _calibration_bins(df, row_key, n_bins, keys)
    return g.select(*keys, F.col("seg").alias("bin"), F.col("rows").alias("n"), r6(F.col("p_sum") / F.col("rows")).alias("mean_predicted"),
                    r6(F.col("hits") / F.col("rows")).alias("observed_rate"))


def calibration_summary(df: DataFrame, row_key: Sequence[str], n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """ECE (from unrounded bin means), overall mean prediction and observed rate."""
    keys = list(keys)
    g = _calibration_bins(df, row_key, n_bins, keys)
    s = g.groupBy(*keys).agg(
        F.sum(F.abs(F.col("p_sum") - F.col("hits")) / F.col("n")).alias("ece"),
        (F.sum("p_sum") / F.sum("rows")).alias("mp"), (F.sum("hits") / F.sum("rows")).alias("obs"),
    )
    return s.select(*keys, r6(F.col("ece")).alias("expected_calibration_error"),
                    r6(F.col("mp")).alias("mean_predicted"), r6(F.col("obs")).alias("observed_rate"))


def band_of(p: Column, cutoffs: dict[str, float] = cs.RISK_BAND_CUTOFFS) -> Column:
    return F.when(p >= cutoffs["HIGH"], "HIGH").when(p >= cutoffs["MEDIUM"], "MEDIUM").otherwise("LOW")


def band_table(df: DataFrame, keys: Sequence[str] = (), band_col: str | None = None) -> DataFrame:
    """Per band in fixed order (empty bands kept): customers, share, observed churn rate, churners."""
    keys = list(keys)
    band = F.col(band_col) if band_col else band_of(F.col("p"))
    g = df.groupBy(*keys, band.alias("band")).agg(F.count(F.lit(1)).cast("bigint").alias("customers"),
                                                  F.sum(F.col("y").cast("bigint")).alias("churners"))
    tot = g.groupBy(*keys).agg(F.sum("customers").alias("total"))
    dims = tot.select(*keys, "total", F.posexplode(F.array(*[F.lit(b) for b in cs.BAND_ORDER])).alias("band_order", "band"))
    j = dims.join(g, [*keys, "band"], "left")
    n = F.coalesce(F.col("customers"), F.lit(0)).cast("bigint")
    return j.select(*keys, "band", F.col("band_order").cast("int").alias("band_order"), n.alias("customers"),
                    r6(F.when(F.col("total") > 0, n / F.col("total"))).alias("share_of_customers"),
                    r6(F.when(n > 0, F.coalesce(F.col("churners"), F.lit(0)) / n)).alias("observed_churn_rate"),
                    F.coalesce(F.col("churners"), F.lit(0)).cast("bigint").alias("churners"))
