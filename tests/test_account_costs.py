"""Steps that all account queries share do each piece of work once, with the results they had."""

from __future__ import annotations

import pytest
from conftest import accounts_table
from pyspark.sql import functions as F

from churnlens.functions.exprs import md5_below, md5_of, md5_uniform
from churnlens.operators.contract import validate
from churnlens.plans import q_models


def test_hash_digits_compare_as_the_uniforms_do(spark):
    shares = (0.16, 0.25, 0.35, 0.5, 0.55, 0.75, 0.8, 0.9)
    keys = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    wrong = [(md5_below(md5_of("s", "k"), p).eqNullSafe(md5_uniform("s", "k") < p)) for p in shares]
    assert keys.where(~F.greatest(*[~w for w in wrong])).count() == 5000
    # a hash whose first digits equal the border is not below it
    assert spark.range(1).select(md5_below(F.lit("80000000" + "0" * 24), 0.5), md5_below(F.lit("7fffffff" + "f" * 24), 0.5)).first()[:] == (False, True)


@pytest.mark.parametrize("changes", [
    {1: {"gender": " Male"}, 2: {"Contract": " ", "gender": "\tFemale "}, 3: {"customerID": ""}},
    {1: {"Churn": "Maybe"}, 2: {"PaymentMethod": "Cash"}, 4: {"MonthlyCharges": " 20.00", "Partner": ""}}, {}])
def test_the_gate_counts_what_the_report_counts(raw_df, changes):
    rows = [row | changes.get(i, {}) for i, row in enumerate(accounts_table())]
    gate = validate(raw_df(rows)).errors()
    full = validate(raw_df(rows))
    full.rows()
    assert gate == full.errors() and bool(gate) == bool(changes)


def test_predictions_of_all_models_come_from_one_read(spark, tmp_path):
    rows = spark.createDataFrame([(0, k % 2, f"a{k}", k % 3 // 2, 5 + k, 20.0, 90.0, 1) for k in range(8)],
                                 "repeat long, fold long, customer_id string, churn long, tenure_months long, monthly_charges double, total_charges double, num_addon_services long")
    m = q_models.FIXED_MODELS["fixed_logistic"].pre
    flags = [F.lit(k % 2).alias(c) for k, c in enumerate(m.spec.binary)]
    rows = rows.select("*", *flags, *[F.lit(m.levels[c][0]).alias(c) for c in m.spec.categorical])
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    out = q_models.oof_predictions(stored)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # the priors' counts and one read of the rows
    got = {(r.model, r.customer_id): r.p for r in out.collect()}
    assert len(got) == 8 * len(q_models.MODEL_ORDER)
    for name, model in q_models.FIXED_MODELS.items():
        for r in stored.select("customer_id", F.round(model.probability(), 6).alias("p")).collect():
            assert got[name, r.customer_id] == r.p
