from __future__ import annotations

import json
import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.functions.exprs import signed_hundredths
from churnlens.operators import scoring as sc
from churnlens.operators.contract import DataContractError
from churnlens.plans import score_flow as flow
from churnlens.session import scratch_path
from churnlens.sources import registry as rg
from conftest import account, accounts_table


@pytest.fixture(scope="module")
def saved(spark):
    """The fixed model, saved with the test table as its training table."""
    rows = [tuple(r[c] for c in cs.RAW_COLUMNS) + (i,) for i, r in enumerate(accounts_table())]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cs.RAW_COLUMNS) + ", _row bigint")
    m = sc.fixed_account_model()
    known = flow.content(raw).first()
    meta = rg.model_metadata(spark, "v1", m.name, {}, cs.SEED, known.fingerprint, known.n_rows, m.pre.spec, sc.fixed_reference_profile(m.pre)).first().asDict()
    return rg.save_model(spark, m, meta, scratch_path(spark, "saved")), raw


def _encoded(row: dict[str, str]) -> dict[str, float]:
    """Encoded inputs of a raw row under the fixed model, in plain Python."""
    m = sc.fixed_account_model()
    clean = {cs.RAW_TO_CLEAN[k]: v for k, v in row.items()}
    number = {"tenure_months": float(row["tenure"]), "monthly_charges": float(row["MonthlyCharges"]), "total_charges": float(row["TotalCharges"].strip() or 0),
              "num_addon_services": float(sum(row[c] == "Yes" for c in cs.INTERNET_ADDONS_RAW))}
    out = {}
    for name, source, level in m.pre.encoded:
        if source in number:
            out[name] = (number[source] - m.pre.means[source]) / m.pre.stds[source]
        else:
            out[name] = float(clean[source] == (level if level is not None else "Yes"))
    return out


def test_records_equal_plain_python(saved):
    path, raw = saved
    stamp = datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
    records = flow.score_saved(raw, path, scored_at=stamp)
    assert records.columns == ["customer_id", "risk_score", "risk_band", "model_version", "prediction_timestamp", "top_reasons", "in_sample"]
    got = {r.customer_id: r for r in sc.records_to_frame(records).collect()}
    m = sc.fixed_account_model()
    reference = sc.fixed_reference_profile(m.pre)
    source = {n: s for n, s, _ in m.pre.encoded}
    for row in accounts_table():
        r, x = got.pop(row["customerID"]), _encoded(row)
        score = 1 / (1 + math.exp(-(m.intercept + sum(m.coef[n] * v for n, v in x.items()))))
        assert abs(r.risk_score - score) < 1e-6 and r.in_sample and r.model_version == "v1" and r.prediction_timestamp == "2026-01-02T03:04:05+00:00"
        pushed: dict[str, float] = {}
        for n, v in x.items():
            pushed[source[n]] = pushed.get(source[n], 0.0) + m.coef[n] * (v - reference[n])
        top = sorted((-c, f) for f, c in pushed.items() if c > 1e-12)[:3]
        reasons = json.loads(r.top_reasons)
        assert [x["feature"] for x in reasons] == [f for _, f in top]
        for x, (c, _) in zip(reasons, top, strict=True):
            assert list(x) == sorted(x) and abs(x["contribution_log_odds"] + c) < 1e-6 and x["causal_claim"] is False
            assert f"{-c:+.2f}" in x["statement"] and x["value"] in x["statement"] and x["statement"].endswith(cs.CAVEAT)
    assert not got


def test_hundredths_round_the_binary_value(spark):
    values = [0.175, 0.125, 0.375, 0.005, 1.005, 2.675, -0.175, -0.001, 0.995, 16.995, 0.0, 7.0, 1e-9, *[k / 1000 for k in range(-1500, 1500, 5)], *[k / 7 for k in range(-40, 40)]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", signed_hundredths(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in got if r.t != f"{r.v:+.2f}"] == []


def test_unlabelled_and_changed_tables_are_out_of_sample(saved):
    path, raw = saved
    scores = {r.customer_id: r.risk_score for r in flow.score_saved(raw, path).collect()}
    unlabelled = flow.score_saved(raw.drop(cs.RAW_TARGET), path)
    assert {r.customer_id: r.risk_score for r in unlabelled.collect()} == scores
    assert not any(r.in_sample for r in unlabelled.collect())
    assert not any(r.in_sample for r in flow.score_saved(raw.where("_row > 0"), path).collect())
    assert all(r.in_sample for r in flow.score_saved(raw.repartition(3).orderBy(F.desc("_row")), path).collect())


def test_records_are_written_and_read_back(spark, saved):
    path, raw = saved
    records = flow.score_saved(raw, path)
    out = flow.write_records(records, scratch_path(spark, "out"))
    assert spark.read.parquet(out["parquet"]).count() == records.count()
    nested = {r.customer_id: [x.feature for x in r.top_reasons] for r in spark.read.json(out["json"]).collect()}
    flat = {r.customer_id: [x["feature"] for x in json.loads(r.top_reasons)] for r in spark.read.option("header", True).option("escape", '"').csv(out["csv"]).collect()}
    assert nested == flat == {r.customer_id: [x.feature for x in r.top_reasons] for r in records.collect()}


def test_broken_inputs_are_refused(spark, saved, raw_df):
    path, raw = saved
    with pytest.raises(DataContractError):
        flow.score_saved(raw_df([account(1, MonthlyCharges="-1")]), path)
    with pytest.raises(FileNotFoundError):
        flow.score_saved(raw, scratch_path(spark, "nowhere"))
    good = flow.score_saved(raw, path)
    claims = good.withColumn("top_reasons", F.transform("top_reasons", lambda r: r.withField("causal_claim", F.lit(True))))
    for broken in (claims, good.withColumn("risk_score", F.lit(1.5)), good.withColumn("risk_band", F.lit("SAFE")), good.withColumn("customer_id", F.lit(""))):
        with pytest.raises(ValueError, match="output contract"):
            sc.assert_output_contract(broken)
