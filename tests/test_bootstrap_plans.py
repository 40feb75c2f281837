"""The bootstraps' work by row stays where the rows are read; the weights are those of the definition."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from churnlens.operators import audit as au
from churnlens.operators import resample as rs

THR = {"best_f1": 0.3, "high_band": 0.5}


@pytest.fixture
def rows(spark):
    data = [("dev", "a", None if i == 7 else "xy"[i % 2], i % 3 % 2, round(0.1 * (i % 4), 6), i // 2) for i in range(90)]
    return data, spark.createDataFrame(data, "eval_set string, attribute string, value string, y bigint, p double, k bigint")


def test_weights_are_poisson_by_md5(rows):
    data, long = rows
    want = Counter()
    for s, a, v, y, p, k in data:
        for b in range(4):
            u = int(hashlib.md5(f"42:{a}:{b}:{k}".encode()).hexdigest()[:8], 16) / 2**32
            want[s, a, v, b, p, y] += sum(u >= c for c in au.poisson1_cdf_points())
    got = {(r.eval_set, r.attribute, r.value, r.replicate, r.p, r.y): r.w for r in au.bootstrap_weights(long, 4, 42, ["k"]).collect()}
    assert got == dict(want)


def test_only_cells_are_unpivoted_by_replicate(rows):
    plan = au.bootstrap_weights(rows[1], 4, 42, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the tree is printed from its top


@pytest.mark.parametrize("bootstrap", [
    lambda long: au.bootstrap_intervals(long, THR, 4, ["k"])[1], lambda long: rs.replicate_metrics(long, THR, 4, 42)])
def test_rows_are_not_dealt_by_group(spark, rows, bootstrap):
    """Only counted cells meet the list of groups, so no group's rows go to one task."""
    seen = []
    plain = type(rows[1]).join

    def join(self, other, on=None, how=None):
        if how == "left_semi":
            seen.append(self._jdf.queryExecution().analyzed().toString())
        return plain(self, other, on, how)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows[1]), "join", join)
        bootstrap(rows[1])
    assert seen and all("Aggregate" in s for s in seen)
