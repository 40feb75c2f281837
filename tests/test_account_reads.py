"""Account queries work through the raw rows once: cleaning is stored where splits read it again, and cells
and reasons cost no more than their output needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.functions.exprs import _WS, strip_ws
from churnlens.operators import explain as ex
from churnlens.operators import scoring as sc
from churnlens.plans import pipeline as pl
from churnlens.plans import q_audit, q_models


def _customers(spark, path):
    spark.range(1, 301).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(path / "customer.parquet"))
    return str(path)


def _count_raw(monkeypatch):
    calls, made = [], pl.raw_accounts
    monkeypatch.setattr(pl, "raw_accounts", lambda *a, **k: calls.append(a) or made(*a, **k))
    return calls


def test_account_audit_cleans_once(spark, tmp_path, monkeypatch):
    sf, calls = _customers(spark, tmp_path), _count_raw(monkeypatch)
    r = q_audit.account_audit_join(spark, sf).first()
    assert r.n_scored == 300 and len(calls) == 1
    assert q_audit.account_group_metrics(spark, sf).count() > 0 and len(calls) == 2


def test_cleaned_groups_and_folds_are_read_from_files(spark, tmp_path):
    sf = _customers(spark, tmp_path)
    for df in (pl.cleaned_accounts(spark, sf), q_models.account_folds(spark, sf)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert q_models.account_folds(spark, sf).count() == 900


def test_strip_matches_the_regular_expression(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "\ta\n", "\u00a0x\u2003", "\u00e9", "\u00e9 ", "x\u0085", "\x1cx", "x\n", "~", "!", "\x7f", "\U0001f600", " \U0001f600 ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(strip_ws("t").alias("a"), F.regexp_replace("t", f"^{_WS}+|{_WS}+$", "").alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_reason_rows_make_no_texts(spark, tmp_path):
    features = pl.account_features(spark, _customers(spark, tmp_path), groups=False)
    model = sc.fixed_account_model()
    explainer = ex.LinearExplainer(model, dict.fromkeys(model.pre.names, 0.25))
    rows = explainer.reason_rows(features)
    assert cs.CAVEAT not in rows._jdf.queryExecution().optimizedPlan().toString()
    long = features.select("customer_id", F.posexplode(explainer.reasons(3)).alias("pos", "x")).select(
        "customer_id", (F.col("pos") + 1).cast("bigint"), "x.feature", "x.contribution_log_odds")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, long.collect()))
