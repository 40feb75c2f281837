"""The design table: one encoded row per customer that every fit of a training run reads.

A run has many fits (model variants x repeats x folds, a holdout fit, a final fit). They differ in
which rows and which columns they use, not in the encoding, so rows are encoded once, for the union
of all columns, and stored: ``x`` is 1, the numerics scaled by their mean and deviation over all
rows (only for numerical range; each fit still standardises by its own training rows), the binaries
and one column per category level. ``folds[r]`` is the row's validation fold in repeat r and
``is_test`` marks the holdout. A level that a fit's training rows lack is a column of zeros there, so
the ridge penalty leaves it at 0, the same as an unseen level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import splits as sp
from churnlens.operators.features import DEFAULT_SPEC, FeatureSpec, Preprocessor, fit_preprocessor
from churnlens.session import stored


@dataclass(frozen=True)
class Fit:
    """One fit: the columns of ``spec`` on the training rows of (repeat, fold); with fold -1 on all rows
    outside the holdout, with ``everything`` on all rows."""

    model: str
    spec: FeatureSpec
    repeat: int = -1
    fold: int = -1
    everything: bool = False


@dataclass
class Design:
    table: DataFrame
    base: Preprocessor
    n_splits: int
    n_repeats: int

    @property
    def width(self) -> int:
        return 1 + len(self.base.names)

    def columns(self, spec: FeatureSpec) -> list[int]:
        """Places of a spec's encoded columns in ``x``, in the order of its preprocessor."""
        at = {(src, lvl): k + 1 for k, (_, src, lvl) in enumerate(self.base.encoded)}
        pre = Preprocessor(spec, dict.fromkeys(spec.numeric, 0.0), dict.fromkeys(spec.numeric, 1.0), self.base.levels)
        return [at[src, lvl] for _, src, lvl in pre.encoded]


def design(features: DataFrame, n_splits: int = 5, n_repeats: int = 3, seed: int = cs.SEED, spec: FeatureSpec = DEFAULT_SPEC) -> Design:
    """Split, fold, encode and store ``features`` (labelled, with ``duplicate_group_id``)."""
    wide = spec.with_protected()
    group = "duplicate_group_id"
    frame = stored(sp.holdout_split(features, seed), "labelled")
    folds = sp.group_folds(frame.where(~F.col("is_test")), n_splits, n_repeats, seed).groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"].cast("int")).alias("folds"))  # one entry a repeat
    base = fit_preprocessor(frame, wide)
    x = F.array(F.lit(1.0), *[base.column(n) for n in base.names])
    table = frame.join(folds, group, "left").select(
        cs.CLEAN_ID, group, F.col(cs.TARGET).cast("int").alias("y"), "is_test",
        F.coalesce("folds", F.array(*[F.lit(-1)] * n_repeats)).alias("folds"), x.alias("x"))
    return Design(stored(table, "design"), base, n_splits, n_repeats)


def cv_fits(model: str, spec: FeatureSpec, n_splits: int, n_repeats: int) -> list[Fit]:
    return [Fit(model, spec, r, k) for r in range(n_repeats) for k in range(n_splits)]


def matrix(col: pa.Array, kind=np.float64) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(col), -1)


def training_rows(fits: list[Fit], is_test: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """(rows, fits): whether a row trains a fit."""
    out = np.empty((len(is_test), len(fits)), bool)
    for j, f in enumerate(fits):
        out[:, j] = True if f.everything else ~is_test if f.fold < 0 else ~is_test & (folds[:, f.repeat] != f.fold)
    return out
