from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators import evaluate as ev
from churnlens.operators.ordered import distributed_rank, running_sum
from churnlens.plans.q_eval import lines
from conftest import SF_SMALL


def frame(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "k long, y long, p double")


def brute_auc(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= t and a == 0)
        rec = tp / P
        ap += (rec - prev) * tp / (tp + fp)
        prev = rec
    return ap


def test_hand_computed_confusion(spark):
    df = frame(spark, [1, 1, 0, 0, 1, 0], [.9, .4, .6, .1, .8, .2])
    r = ev.threshold_table(df, [0.5]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)
    assert r.precision == round(2 / 3, 6) and r.recall == round(2 / 3, 6)


def test_auc_ap_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300).tolist()
    p = (rng.integers(0, 20, 300) / 20).tolist()
    m = ev.ranking_metrics(frame(spark, y, p)).first()
    assert abs(m.roc_auc - round(brute_auc(y, p), 6)) < 1e-6
    assert abs(m.pr_auc - round(brute_ap(y, p), 6)) < 1e-6
    keyed = ev.ranking_metrics(frame(spark, y, p).withColumn("g", F.col("k") % 3), ["g"]).orderBy("g").collect()
    for g, row in enumerate(keyed):
        yy = [a for i, a in enumerate(y) if i % 3 == g]
        pp = [b for i, b in enumerate(p) if i % 3 == g]
        assert abs(row.roc_auc - round(brute_auc(yy, pp), 6)) < 1e-6


def test_undefined_metrics_are_null(spark):
    m = ev.ranking_metrics(frame(spark, [1, 1, 1], [.2, .5, .9])).first()
    assert m.roc_auc is None and m.pr_auc is None and m.brier is not None
    t = ev.threshold_table(frame(spark, [0, 0], [.1, .2]), [0.5]).first()
    assert t.precision is None and t.recall is None and t.f1 is None


def test_distributed_rank_and_running_sum_match_windows(spark):
    sl = lines(spark, SF_SMALL).select("p", "y", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
                                       "l_extendedprice")
    order = [F.col("p").desc(), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
    for parts in (1, 3, 16):
        r = distributed_rank(sl, order, num_partitions=parts)
        ref = sl.withColumn("ref", F.row_number().over(Window.orderBy(*order)))
        bad = r.join(ref, keys).where(F.col("rank") != F.col("ref")).count()
        assert bad == 0, parts
    h = ev.histogram(sl)
    c = running_sum(h, [F.col("p").asc()], ["pos"], num_partitions=5)
    ref = h.withColumn("ref", F.sum("pos").over(Window.orderBy("p")))
    assert c.join(ref, "p").where(F.abs(F.col("cum_pos") - F.col("ref")) > 1e-9).count() == 0


def test_calibration_bins_are_equal_count(spark):
    df = frame(spark, [i % 2 for i in range(23)], [i / 23 for i in range(23)])
    b = ev.calibration_table(df, ["k"], 5).orderBy("bin").collect()
    assert [r.n for r in b] == [5, 5, 5, 4, 4]


def test_capacity_ties_broken_by_row_key(spark):
    df = frame(spark, [1, 0, 0, 1], [.5, .5, .5, .1])
    r = ev.capacity_table(df, ["k"], [0.5]).first()
    assert r.customers_contacted == 2 and r.precision == 0.5


def test_best_f1_lowest_threshold_on_ties(spark):
    df = frame(spark, [1, 0], [.9, .1])
    assert ev.best_f1_threshold(df).first().best_f1_threshold == 0.11


def test_cuts_match_a_full_ranking(spark):
    """Segments of the histogram equal ranks of all rows: few scores, one constant score, one row a key."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 2)), float(p), g) for g, ps in (("few", rng.integers(0, 4, 97) / 4), ("one", [0.3] * 41), ("all", rng.random(60)), (None, [0.7]))
            for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "k long, y long, p double, g string")
    named = df.where("g is not null")
    cap = {(r.g, r.top_fraction): r for r in ev.capacity_table(named, ["k"], keys=["g"]).collect()}
    bins = {(r.g, r.bin): r for r in ev.calibration_table(named, ["k"], 7, ["g"]).collect()}
    for g in ("few", "one", "all"):
        own = [r for r in rows if r[3] == g]
        down, up = sorted(own, key=lambda r: (-r[2], r[0])), sorted(own, key=lambda r: (r[2], r[0]))
        for f in ev.CAPACITY_FRACTIONS:
            k = max(1, round(f * len(own)))
            r = cap[g, f]
            assert r.customers_contacted == k and abs(r.precision - sum(x[1] for x in down[:k]) / k) < 1e-6
        for b, part in enumerate(np.array_split(np.array([(x[1], x[2]) for x in up]), 7)):
            r = bins[g, b]
            assert r.n == len(part) and abs(r.observed_rate - part[:, 0].mean()) < 1e-6 and abs(r.mean_predicted - part[:, 1].mean()) < 1e-6
    keyed = {r.g: r for r in ev.ranking_metrics(df, ["g"]).collect()}
    assert set(keyed) == {"few", "one", "all", None} and keyed[None].roc_auc is None and keyed["one"].n == 41
    for g in ("few", "all"):
        own = [r for r in rows if r[3] == g]
        assert abs(keyed[g].roc_auc - brute_auc([r[1] for r in own], [r[2] for r in own])) < 1e-6
        assert abs(keyed[g].pr_auc - brute_ap([r[1] for r in own], [r[2] for r in own])) < 1e-6


def test_cuts_do_not_rank_the_table(spark, monkeypatch):
    """Only the rows of a divided score reach the ranking."""
    seen = []

    def counted(df, *args, **kw):
        seen.append(df.count())
        return distributed_rank(df, *args, **kw)
    monkeypatch.setattr(ev, "distributed_rank", counted)
    df = frame(spark, [i % 3 == 0 for i in range(500)], [(i % 100) / 100 for i in range(500)])
    ev.capacity_table(df, ["k"]).collect()
    ev.calibration_table(df, ["k"], 3).collect()
    assert seen == [0, 10]  # every top fraction is a multiple of 5 rows; the bins end after 167 and 334
