"""The grouped forest: splits against a plain search, group size without effect, saved and loaded alike."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import features as ft
from churnlens.operators import forest as fo
from churnlens.operators import models as md
from churnlens.sources import registry as rg


def _table(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    bins = np.stack([rng.integers(0, 32, n), rng.integers(0, 7, n), rng.integers(0, 2, n), rng.integers(0, 2, n)], 1).astype(np.uint8)
    return bins, (rng.random(n) < 0.2 + 0.5 * bins[:, 2] * (bins[:, 0] > 11)).astype(np.uint8), rng.poisson(1, n).astype(np.uint8)


def _plain(bins, y, w, node, tree):
    """Share of each row's leaf, node by node, and whether the subtree is a leaf."""
    n, pos = int(w.sum()), int(w @ y.astype(int))
    best = None
    if node.bit_length() - 1 < fo.DEPTH and 0 < pos < n:
        for c in fo.columns_tried(1, tree, np.array([node]), bins.shape[1])[0]:
            for cut in range(31):
                left = bins[:, c] <= cut
                nl, pl = int(w[left].sum()), int(w[left] @ y[left].astype(int))
                if min(nl, n - nl) >= fo.MIN_ROWS:
                    gain = pl**2 / nl + (pos - pl) ** 2 / (n - nl) - pos**2 / n
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, c, cut
    share = np.full(len(y), pos / max(n, 1))
    if best is None:
        return share, True, pos / max(n, 1)
    left = bins[:, best[1]] <= best[2]
    a = _plain(bins[left], y[left], w[left].astype(int), 2 * node, tree)
    b = _plain(bins[~left], y[~left], w[~left].astype(int), 2 * node + 1, tree)
    if a[1] and b[1] and (a[2] > 0.5) == (b[2] > 0.5):
        return share, True, pos / n
    share[left], share[~left] = a[0], b[0]
    return share, False, pos / n


@pytest.mark.parametrize("tree", [0, 1])
def test_a_subtree_has_the_splits_of_a_plain_search(tree, monkeypatch):
    monkeypatch.setattr(fo, "SLICE", 3)
    bins, y, w = _table(400)
    got = fo.leaf_shares(fo.grow(bins, y, w, 1, tree, 1), bins)
    assert len(np.unique(got)) > 5
    np.testing.assert_allclose(got, _plain(bins, y, w.astype(int), 1, tree)[0], atol=1e-12)


def test_draws_are_poisson_and_columns_differ_by_node():
    w = fo.draws(3, 7, np.arange(200_000))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    tried = fo.columns_tried(3, 7, np.arange(1, 4000), 25)
    assert tried.shape == (3999, 5) and (np.diff(tried, axis=1) > 0).all()
    assert (np.abs(np.bincount(tried.ravel()) / 3999 - 0.2) < 0.03).all()


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000))
    made = spark.range(600).select(F.col("id").cast("string").alias(cs.CLEAN_ID), (h("a") % 73).alias("t"), (h("b") % 2).alias("b"), (h("c") % 3).cast("string").alias("c"), h("y").alias("u"))
    return made.select(cs.CLEAN_ID, "t", "b", "c", (F.col("u") < 150 + 500 * F.col("b") * (F.col("t") > 30).cast("int")).cast("bigint").alias(cs.TARGET)).repartition(3).localCheckpoint()


SPEC = ft.FeatureSpec.of(numeric=["t"], binary=["b"], categorical=["c"])


def _scores(model, rows):
    return {r[0]: r.p for r in md.predict(model, rows, (cs.CLEAN_ID,)).collect()}


def test_group_size_changes_nothing_and_the_signal_is_found(rows, spark, tmp_path):
    whole = fo.fit_forest(rows, SPEC, trees=12)
    small = fo.fit_forest(rows, SPEC, trees=12, group_rows=60)
    assert not any(whole.top) and any(small.top)
    a, b = _scores(whole, rows), _scores(small, rows)
    assert len(a) == 600 and a == pytest.approx(b, abs=1e-12)
    truth = {r[0]: (0.65 if r.b and r.t > 30 else 0.15) for r in rows.select(cs.CLEAN_ID, "b", "t").collect()}
    assert np.mean([abs(a[k] - truth[k]) for k in truth]) < 0.13
    rg.save_model(spark, small, {"explanation_reference": "{}"}, str(tmp_path / "m"))
    assert _scores(rg.load_model(spark, str(tmp_path / "m"))[0], rows) == pytest.approx(b, abs=1e-12)


def test_rows_without_a_label_are_refused(rows):
    with pytest.raises(ValueError, match="no label"):
        fo.fit_forest(rows.withColumn(cs.TARGET, F.when(F.col("t") > 5, F.col(cs.TARGET))), SPEC, trees=2)
