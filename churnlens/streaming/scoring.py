"""Scoring a stream of raw account rows with the same stateless Column expressions as batch.

Row-level cleaning, feature derivation, the logistic score, the band and the reasons are all
pure projections, so they apply unchanged to a ``readStream`` frame. What needs the whole table
(contract aggregates, duplicate-profile groups) is not available per micro-batch: the stream
applies the row-level contract predicates as a filter-and-flag instead, and leaves the
duplicate-group id NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.functions.exprs import is_blank, parse_number
from churnlens.operators.features import derive_features
from churnlens.operators.scoring import LinearModel, band


def clean_rows(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Row-wise part of cleaning (no duplicate groups): typed columns + audit flags."""
    present = [c for c in cs.RAW_COLUMNS if c in raw.columns]
    tenure = parse_number("tenure").cast("bigint")
    cols = []
    for c in present:
        name = cs.RAW_TO_CLEAN[c]
        if c == "tenure":
            cols.append(tenure.alias(name))
        elif c == "MonthlyCharges":
            cols.append(parse_number(c).alias(name))
        elif c == "TotalCharges":
            cols.append(F.when(is_blank(c), F.lit(0.0)).otherwise(parse_number(c)).alias(name))
        elif c == "SeniorCitizen":
            cols.append(parse_number(c).cast("bigint").alias(name))
        elif c == cs.RAW_TARGET:
            cols.append(F.when(F.col(c) == "Yes", 1).when(F.col(c) == "No", 0).cast("bigint").alias(name))
        else:
            cols.append(F.col(c).alias(name))
    cols += [is_blank("TotalCharges").alias("total_charges_was_blank"),
             F.lit(None).cast("bigint").alias("duplicate_group_id"), *[F.col(k) for k in keep]]
    return raw.select(*cols)


def row_valid(raw: DataFrame) -> F.Column:
    """Row-level contract predicates that can be judged without the rest of the table."""
    t, m = parse_number("tenure"), parse_number("MonthlyCharges")
    ok = (~is_blank(cs.RAW_ID)) & t.isNotNull() & (t >= 0) & (t % 1 == 0) & m.isNotNull() & (m > 0)
    for c, dom in cs.CATEGORICAL_DOMAINS.items():
        if c in raw.columns:
            ok = ok & F.col(c).isin(*dom)
    return F.coalesce(ok, F.lit(False))


def score_stream(raw: DataFrame, model: LinearModel, model_version: str) -> DataFrame:
    """customer_id, risk_score, risk_band, model_version, row_valid for each incoming row."""
    flagged = raw.withColumn("row_valid", row_valid(raw))
    feats = derive_features(clean_rows(flagged, keep=("row_valid",)), keep=("row_valid",))
    scored = feats.select(cs.CLEAN_ID, "row_valid",
                          F.round(model.probability(), cs.SCORE_DECIMALS).alias("risk_score"))
    return scored.select(cs.CLEAN_ID, "risk_score", band(F.col("risk_score")).alias("risk_band"),
                         F.lit(model_version).alias("model_version"), "row_valid")
