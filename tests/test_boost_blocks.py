"""Boosting on blocks of rows: packed counts, trees grown whole or by levels, and the Spark jobs they take."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import DataFrame

from churnlens.operators import keyed_boost as kb
from churnlens.operators.design import Fit
from churnlens.operators.features import DEFAULT_SPEC
from churnlens.session import stored

SIZES = [1, 200, 3, 2, 2, 9, 2, 2, 2, 2]
FITS = [Fit("b", DEFAULT_SPEC, 0, 0), Fit("b", DEFAULT_SPEC, 0, 1), Fit("b", DEFAULT_SPEC)]


def test_counts_of_packed_columns_equal_plain_sums():
    r = np.random.default_rng(7)
    n, columns = 500, [1, 2, 4, 5, 6, 7, 8, 9]
    bins = np.stack([r.integers(0, s, n) for s in SIZES], 1).astype(np.uint8)
    g, h, at = r.normal(size=n), r.random(n), r.integers(0, 4, n).astype(np.uint8)
    layout = kb.Layout(SIZES, columns)
    assert len(layout.bits) < len(columns) and max(layout.bits) <= kb.CODE_BITS
    codes, counts = layout.codes(bins), layout.empty(2)
    for part in (slice(0, 180), slice(180, n)):
        layout.add(counts, codes[:, part], at[part], g[part], h[part])
    want = np.zeros((4, 3, sum(SIZES)))
    for c in columns:
        for i, v in enumerate((g, h, np.ones(n))):
            np.add.at(want[:, i], (at, sum(SIZES[:c]) + bins[:, c]), v)
    assert np.allclose(layout.sums(counts, columns, 2), want, atol=1e-12)
    lines = kb.Lines(codes, layout)
    for c in columns:
        for cut in range(SIZES[c]):
            assert (lines.over(c, cut) == (bins[:, c] > cut)).all()


@dataclass
class _Design:
    table: DataFrame
    width: int = 8

    def columns(self, spec) -> list[int]:
        return list(range(1, self.width))


@pytest.fixture(scope="module")
def design(spark):
    r = np.random.default_rng(5)
    n = 400
    x = np.column_stack([np.ones(n), r.normal(size=n).round(2), r.integers(0, 6, n), *[r.integers(0, 2, n) for _ in range(5)]])
    y = (r.random(n) < 1 / (1 + np.exp(-x[:, 1] - x[:, 3] + x[:, 4] * x[:, 2] / 3))).astype(int)
    rows = [(f"c{k}", x[k].tolist(), int(y[k]), k % 5 == 0, [k % 2 if k % 5 else -1]) for k in range(n)]
    return _Design(stored(spark.createDataFrame(rows, "customer_id string, x array<double>, y int, is_test boolean, folds array<int>").repartition(3), "design"))


def _jobs(spark, group: str, work) -> int:
    spark.sparkContext.setJobGroup(group, group)
    work()
    spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_rounds_on_a_small_table_take_no_jobs_of_their_own(spark, design):
    edges = kb.bin_edges(design.table, design.width)
    few, many = (_jobs(spark, f"whole-{k}", lambda k=k: kb.fit_boosted(design, FITS, k, edges)) for k in (2, 6))
    assert few == many


def test_a_level_on_a_large_table_is_one_job_over_blocks(spark, design, monkeypatch):
    monkeypatch.setattr(kb, "FIT_BYTES", 0, raising=False)
    monkeypatch.setattr(kb, "TASK_ROWS", 50)
    held = []
    monkeypatch.setattr(kb, "stored", lambda df, name: held.append(stored(df, name)) or held[-1])
    edges = kb.bin_edges(design.table, design.width)
    few, many = (_jobs(spark, f"levels-{k}", lambda k=k: kb.fit_boosted(design, FITS, k, edges)) for k in (2, 6))
    assert many - few == 4 * kb.DEPTH
    assert all(t.count() < design.table.count() / 4 for t in held)


def test_levels_and_whole_fits_grow_the_same_trees(design, monkeypatch):
    edges = kb.bin_edges(design.table, design.width)
    x = np.array([r.x for r in design.table.collect()])
    whole = [m.raw(x) for m in kb.fit_boosted(design, FITS, 7, edges)]
    assert all(len(set(w.round(6))) > 5 for w in whole)
    monkeypatch.setattr(kb, "FIT_BYTES", 0)
    monkeypatch.setattr(kb, "TASK_ROWS", 50)
    monkeypatch.setattr(kb, "KEEP", 3)  # raw scores are brought up to date twice on the way
    for limit in (kb.DRIVER_BYTES, 0):  # sums added up by the driver, and dealt
        monkeypatch.setattr(kb, "DRIVER_BYTES", limit)
        assert all(np.allclose(m.raw(x), w, atol=1e-9) for m, w in zip(kb.fit_boosted(design, FITS, 7, edges), whole, strict=True))
