"""Cleaning: validated raw text table -> typed table with audit columns.

Narrow projection plus one group-by for the duplicate-profile groups (KI-2). The group table is
numbered by first appearance with a distributed rank and joined back on the profile columns;
a hot profile (one group holding a large share of rows) is split by AQE's skew-join handling
instead of landing in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.functions.exprs import is_blank, parse_number, strip_ws
from churnlens.operators.contract import Validation, validate
from churnlens.operators.ordered import distributed_rank


def duplicate_groups(raw: DataFrame, row_key: str = "_row") -> DataFrame:
    """One row per distinct non-id profile: columns + ``duplicate_group_id`` (0-based, by first
    appearance in row order) + ``duplicate_group_size`` + ``first_row``."""
    present = [c for c in cs.RAW_COLUMNS if c in raw.columns]
    non_id = [c for c in present if c != cs.RAW_ID]
    filled = raw.select(row_key, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in present])
    groups = filled.groupBy(*non_id).agg(
        F.min(row_key).alias("first_row"), F.count(F.lit(1)).cast("bigint").alias("duplicate_group_size")
    )
    ranked = distributed_rank(groups, ["first_row"], out="_gid")
    return ranked.withColumn("duplicate_group_id", F.col("_gid") - 1).drop("_gid")


def clean(raw: DataFrame, validation: Validation | None = None, require_target: bool = True,
          row_key: str = "_row", check: bool = True, groups: bool = True) -> DataFrame:
    """The cleaned table (25 columns, 24 without a target) plus the row-order key. Without ``groups`` the
    duplicate-group columns are left out and cleaning is one narrow projection: no shuffle."""
    if check:
        v = validation if validation is not None else validate(raw, require_target=require_target, row_key=row_key)
        v.raise_on_error()
    present = [c for c in cs.RAW_COLUMNS if c in raw.columns]
    non_id = [c for c in present if c != cs.RAW_ID]
    filled = raw.select(row_key, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in present])
    joined = filled
    if groups:
        joined = filled.join(duplicate_groups(raw, row_key).select(*non_id, "duplicate_group_id", "duplicate_group_size"), non_id, "inner")

    total_blank = is_blank("TotalCharges")
    tenure = parse_number("tenure").cast("bigint")
    term = F.when(F.col("Contract") == "Month-to-month", 1).when(F.col("Contract") == "One year", 12) \
        .when(F.col("Contract") == "Two year", 24)
    out = []
    for raw_col in present:
        name = cs.RAW_TO_CLEAN[raw_col]
        if raw_col == "tenure":
            out.append(tenure.alias(name))
        elif raw_col == "MonthlyCharges":
            out.append(parse_number(raw_col).alias(name))
        elif raw_col == "TotalCharges":
            out.append(F.when(total_blank, F.lit(0.0)).otherwise(parse_number(raw_col)).alias(name))
        elif raw_col == "SeniorCitizen":
            out.append(parse_number(strip_ws(raw_col)).cast("bigint").alias(name))
        elif raw_col == cs.RAW_TARGET:
            out.append(F.when(F.col(raw_col) == cs.POSITIVE_LABEL, 1).when(F.col(raw_col) == cs.NEGATIVE_LABEL, 0)
                       .cast("bigint").alias(name))
        else:
            out.append(F.col(raw_col).alias(name))
    out += [
        total_blank.alias("total_charges_was_blank"),
        *([F.col("duplicate_group_id"), F.col("duplicate_group_size")] if groups else []),
        F.coalesce((term > 1) & (tenure < term), F.lit(False)).alias("contract_term_exceeds_tenure"),
        F.col(row_key),
    ]
    return joined.select(*out)


def drop_blank_totals(raw: DataFrame) -> DataFrame:
    """Exploratory variant (not the pipeline rule): blank totals become NULL and the rows are dropped."""
    parsed = raw.withColumn("TotalCharges", parse_number(F.when(F.col("TotalCharges") != " ", F.col("TotalCharges"))))
    return parsed.na.drop(subset=[c for c in cs.RAW_COLUMNS if c in raw.columns])
