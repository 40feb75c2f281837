"""All logistic fits of a training run in one Newton iteration each.

Ridge-penalised logistic regression (objective ``|w|^2 / 2 + C * log loss``, intercept unpenalised) is
solved by Newton steps. A step needs the gradient and the Gram matrix of each fit's training rows. One
Spark aggregate an iteration makes them for every (model, repeat, fold) at once: a task multiplies the
pair products of its rows with the weights of all fits, which gives one row of sums a fit, and Spark
adds these up by (fit, place). Only sums travel; their size depends on the number of fits and columns,
never on the rows. Means and deviations of the training rows come out of the first step's sums.

A fit whose objective rises takes half of its last step back; a fit that has settled is not evaluated
again. ``w`` is on the standardised columns, as its preprocessor defines them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.design import Design, Fit, matrix, training_rows
from churnlens.operators.features import Preprocessor
from churnlens.operators.scoring import LinearModel


def _sums_map(fits: list[Fit], coef: np.ndarray):
    """Per task and fit: loss, gradient and the upper triangle of the Gram matrix, in this order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = coef.shape[0]
        up = np.triu_indices(d)
        total = np.zeros((len(fits), 1 + d + len(up[0])))
        for batch in batches:
            x, y = matrix(batch.column(0)), batch.column(1).to_numpy().astype(float)
            rows = training_rows(fits, batch.column(2).to_numpy(zero_copy_only=False), matrix(batch.column(3), np.int64))
            eta = x @ coef
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            total[:, 0] += (rows * (np.logaddexp(0, eta) - y[:, None] * eta)).sum(0)
            total[:, 1:1 + d] += (rows * (y[:, None] - p)).T @ x
            total[:, 1 + d:] += (rows * p * (1 - p)).T @ (x[:, up[0]] * x[:, up[1]])
        yield pa.RecordBatch.from_pydict({"fit": pa.array(range(len(fits)), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})
    return run


def _sums(table: DataFrame, fits: list[Fit], coef: np.ndarray) -> np.ndarray:
    d = coef.shape[0]
    parts = table.select("x", "y", "is_test", "folds").mapInArrow(_sums_map(fits, coef), "fit int, sums array<double>")
    summed = parts.select("fit", F.posexplode("sums").alias("place", "s")).groupBy("fit", "place").agg(F.sum("s").alias("s")).toPandas()  # fits x sums
    out = np.zeros((len(fits), 1 + d + d * (d + 1) // 2))
    out[summed["fit"], summed["place"]] = summed["s"]
    return out


def fit_all(design: Design, fits: list[Fit], c: float = 1.0, tol: float = 1e-9, max_iter: int = 50) -> list[LinearModel]:
    """The penalised optimum of every fit, in the order of ``fits``."""
    d = design.width
    up = np.triu_indices(d)
    cols = [np.array([0, *design.columns(f.spec)]) for f in fits]
    raw = np.zeros((d, len(fits)))  # coefficients on the stored columns
    frames: list[np.ndarray] = []  # z = frame @ x, the fit's standardised columns
    scale: list[tuple[np.ndarray, np.ndarray]] = []
    w = [np.zeros(len(k)) for k in cols]
    before = [np.inf] * len(fits)
    step = [np.zeros(len(k)) for k in cols]
    left = list(range(len(fits)))
    for turn in range(max_iter):
        sums = _sums(design.table, [fits[j] for j in left], raw[:, left])
        still = []
        for row, j in zip(sums, left, strict=True):
            gram = np.zeros((d, d))
            gram[up] = row[1 + d:]
            gram += np.triu(gram, 1).T
            if turn == 0:  # every weight is 1/4 here
                n = 4 * gram[0, 0]
                if not n:
                    raise ValueError(f"no training rows for {fits[j]}")
                mean, std = 4 * gram[0] / n, np.ones(d)
                numeric = 1 + np.arange(len(design.base.spec.numeric))
                var = 4 * np.diag(gram)[numeric] / n - mean[numeric] ** 2
                std[numeric] = np.where(var > 1e-12, np.sqrt(np.maximum(var, 0)), 1.0)
                frame = np.zeros((len(cols[j]), d))
                for k, at in enumerate(cols[j]):
                    frame[k, at] = 1 / std[at]
                    if at in numeric:
                        frame[k, 0] = -mean[at] / std[at]
                frames.append(frame)
                scale.append((mean, std))
            pen = np.ones(len(w[j])) / c
            pen[0] = 0.0
            value = row[0] + 0.5 * pen @ (w[j] ** 2)
            if value > before[j] + 1e-10 * abs(before[j]):  # one step too far: back by half of it
                step[j] = step[j] / 2
                w[j] = w[j] - step[j]
            else:
                before[j] = value
                a = frames[j]
                slope = a @ row[1:1 + d] - pen * w[j]
                step[j] = np.linalg.solve(a @ gram @ a.T + np.diag(pen), slope)
                w[j] = w[j] + step[j]
            raw[:, j] = frames[j].T @ w[j]
            if np.max(np.abs(step[j])) > tol:
                still.append(j)
        left = still
        if not left:
            break
    else:
        raise RuntimeError(f"{len(left)} fits did not settle in {max_iter} steps")
    return [_model(design, f, k, s, v) for f, k, s, v in zip(fits, cols, scale, w, strict=True)]


def _model(design: Design, fit: Fit, cols: np.ndarray, scale: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> LinearModel:
    mean, std = scale
    at = {c: k + 1 for k, c in enumerate(design.base.spec.numeric)}
    base = design.base
    pre = Preprocessor(fit.spec, {c: float(base.means[c] + base.stds[c] * mean[at[c]]) for c in fit.spec.numeric},
                       {c: float(base.stds[c] * std[at[c]]) for c in fit.spec.numeric}, base.levels)
    return LinearModel(pre, dict(zip(pre.names, map(float, w[1:]), strict=True)), float(w[0]), name=fit.model)


def stored_coefficients(design: Design, model: LinearModel) -> list[float]:
    """The model's coefficients on the columns of ``x``."""
    base, pre = design.base, model.pre
    out = np.zeros(design.width)
    out[0] = model.intercept
    for at, (name, src, _) in zip(design.columns(pre.spec), pre.encoded, strict=True):
        c = model.coef[name]
        if src in pre.spec.numeric:
            out[0] += c * (base.means[src] - pre.means[src]) / pre.stds[src]
            c *= base.stds[src] / pre.stds[src]
        out[at] = c
    return out.tolist()


def predictions(design: Design, fits: list[Fit], models: list[LinearModel]) -> DataFrame:
    """(model, repeat, fold, customer_id, y, p): each cross-validation fit on its validation rows, each
    other fit on the holdout (repeat and fold -1). A JVM projection: the coefficient table has a row a fit."""
    spark = design.table.sparkSession
    rows = [(f.model, f.repeat, f.fold, stored_coefficients(design, m)) for f, m in zip(fits, models, strict=True) if not f.everything]
    coef = spark.createDataFrame(rows, "model string, repeat int, fold int, coef array<double>")
    wanted = design.table.select("customer_id", "y", "x", F.explode(F.when(F.col("is_test"), F.array(F.struct(F.lit(-1).alias("repeat"), F.lit(-1).alias("fold")))).otherwise(
        F.transform("folds", lambda f, r: F.struct(r.cast("int").alias("repeat"), f.alias("fold"))))).alias("at")).select("customer_id", "y", "x", "at.*")
    eta = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return wanted.join(F.broadcast(coef), ["repeat", "fold"]).select("model", "repeat", "fold", "customer_id", "y", (1 / (1 + F.exp(-eta))).alias("p"))
