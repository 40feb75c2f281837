"""Distributed selection against numpy's linear interpolation."""

from __future__ import annotations

import numpy as np
import pytest

from churnlens.operators.quantiles import exact_quantiles

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@pytest.mark.parametrize("bins", [2, 256])
def test_equals_numpy(spark, bins):
    rng = np.random.default_rng(1)
    columns = {
        "normal": rng.normal(size=501), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "same": np.full(40, -3.0),
        "skewed": np.concatenate((rng.random(200), [1e12, -1e12])), "negative": -rng.random(77), "hot": np.concatenate((np.zeros(900), rng.random(99))),
    }
    rows = [(k, float(v)) for k, vs in columns.items() for v in vs] + [("ties", None), ("normal", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "column string, value double").repartition(5)
    got = exact_quantiles(df, PROBS, bins=bins)
    assert set(got) == set(columns)
    for k, vs in columns.items():
        assert np.allclose(got[k], np.quantile(vs, PROBS), rtol=1e-12, atol=1e-12), k


def test_extremes_of_doubles(spark):
    values = [1.7e308, -1.7e308, 0.0, 5e-324, 1.0]
    got = exact_quantiles(spark.createDataFrame([("a", v) for v in values], "column string, value double"), (0.0, 0.5, 1.0))
    assert got["a"] == [-1.7e308, 5e-324, 1.7e308]


def test_empty(spark):
    assert exact_quantiles(spark.createDataFrame([], "column string, value double"), PROBS) == {}
