"""End-to-end compositions: raw accounts -> validated, cleaned, featurised, scored, valued.

Each step returns a lazy DataFrame; the only actions are the contract verdict (a bounded report)
and, for training, model fitting. Scoring after the contract is one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import clean as cl
from churnlens.operators import features as ft
from churnlens.operators import scoring as sc
from churnlens.operators import value as vl
from churnlens.operators.contract import DataContractError, validate
from churnlens.session import stored
from churnlens.sources import fixtures as fx


def raw_accounts(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """The stand-in raw table, stored: jobs read it as they would a file, several times, and its
    expressions stay out of their generated code."""
    return stored((fx.accounts_dirty if dirty else fx.accounts)(spark, sf_dir), "accounts")


def cleaned_accounts(spark: SparkSession, sf_dir: str, check: bool = True, groups: bool = True) -> DataFrame:
    """Validated, cleaned accounts; the contract's ERROR checks run on every call with ``check``. With
    ``groups`` they are stored: splits read them several times, and each read would group and join again."""
    raw = raw_accounts(spark, sf_dir)
    if check:
        errors = validate(raw, row_key=fx.ROW).errors()
        if errors:
            raise DataContractError(errors)
    cleaned = cl.clean(raw, None, row_key=fx.ROW, check=False, groups=groups)
    return stored(cleaned, "cleaned") if groups else cleaned


def account_features(spark: SparkSession, sf_dir: str, check: bool = True, groups: bool = True) -> DataFrame:
    return ft.derive_features(cleaned_accounts(spark, sf_dir, check, groups))


def scored_accounts(spark: SparkSession, sf_dir: str, check: bool = True, groups: bool = True) -> DataFrame:
    """Features + fixed-model risk_score and risk_band (the scored_accounts fixture)."""
    return score(account_features(spark, sf_dir, check, groups))


def score(feats: DataFrame) -> DataFrame:
    model = sc.fixed_account_model()
    s = feats.withColumn("risk_score", F.round(model.probability(), cs.SCORE_DECIMALS))
    return s.withColumn("risk_band", sc.band(F.col("risk_score")))


def value_frame(spark: SparkSession, sf_dir: str, assumed_months: float = cs.ASSUMED_VALUE_MONTHS) -> DataFrame:
    return vl.value_table(scored_accounts(spark, sf_dir, groups=False), assumed_months)


def band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the value table is an output of its own; reading it back also keeps scoring and sums apart, which
    # together pass the size limit of a generated method
    return vl.band_summary(stored(value_frame(spark, sf_dir), "value-table"))
