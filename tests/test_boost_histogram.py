"""The boosting's histograms against plain sums, on batches that are slices of others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from churnlens.operators import keyed_boost as kb
from churnlens.operators.design import Fit
from churnlens.operators.features import DEFAULT_SPEC

SIZES = [1, 5, 3]


def _tree(places, cuts, leaves) -> kb.Tree:
    return kb.Tree(np.array(places, np.int32), np.array(cuts, np.int32), np.array(leaves, float))


def test_nodes_follow_each_rows_path():
    bins = np.array([[0, b, c] for b in range(5) for c in range(3)], np.uint8)
    tree = _tree([1, 2, 1, 1, 2, 0, 1], [2, 0, 3, 1, 1, kb.BINS, 3], range(8))
    for depth in range(kb.DEPTH + 1):
        want = []
        for row in bins:
            at = 0
            for level in range(depth):
                k = (1 << level) - 1 + at
                at = 2 * at + int(row[tree.place[k]] > tree.cut[k])
            want.append(at)
        assert tree.node(np.ascontiguousarray(bins.T), depth).tolist() == want


def test_histograms_equal_plain_sums():
    r = np.random.default_rng(3)
    n = 60
    bins = np.stack([r.integers(0, s, n) for s in SIZES], 1).astype(np.uint8)
    y, test, folds, raw = r.integers(0, 2, n), r.random(n) < 0.3, r.integers(0, 2, (n, 1)), r.normal(size=(n, 2))
    fits = [Fit("g", DEFAULT_SPEC, 0, 1), Fit("g", DEFAULT_SPEC)]
    old, growing = _tree([1] * 7, [1, 2, 3] + [kb.BINS] * 4, r.normal(size=8)), _tree([2, 1, 1] + [0] * 4, [0, 2, kb.BINS] + [kb.BINS] * 4, np.zeros(8))
    whole = pa.RecordBatch.from_pydict({
        "customer_id": ["a"] * n, "y": pa.array(y, pa.int32()), "is_test": test, "folds": pa.array(list(folds), pa.list_(pa.int32())),
        "bins": pa.array([b.tobytes() for b in bins], pa.binary()), "raw": pa.array(list(raw), pa.list_(pa.float64()))})
    columns = [[1, 2], [2]]
    out = list(kb._histogram_map(fits, columns, [[old], []], [growing, growing], 2, SIZES)([whole.slice(0, 25), whole.slice(25)]))
    got = {(f, k): np.frombuffer(s, float).reshape(3, -1) for f, k, s in zip(*(c.to_pylist() for c in out[0].columns), strict=True)}
    offset = np.concatenate(([0], np.cumsum(SIZES)))
    want: dict = {}
    down = np.ascontiguousarray(bins.T)
    at, leaf = growing.node(down, 2), old.leaf[old.node(down)]
    for j in range(2):
        for i in range(n):
            if test[i] or (j == 0 and folds[i, 0] == 1):
                continue
            p = 1 / (1 + np.exp(-(raw[i, j] + (leaf[i] if j == 0 else 0))))
            sums = want.setdefault((j, int(at[i])), np.zeros((3, offset[-1])))
            for c in columns[j]:
                sums[:, offset[c] + bins[i, c]] += (p - y[i], p * (1 - p), 1)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
