"""Group-safe, stratified fold assignment and its integrity audit.

Folds are assigned to duplicate GROUPS, never to rows, so identical profiles stay on one side.
Within each (repeat, stratum) the groups are ordered by md5(seed+repeat : group) and dealt out
round-robin (rank mod K), which balances every stratum to +/-1 group per fold. The rank is a
distributed row number (range partitions), so no single task sorts a whole stratum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.functions.exprs import cond_count
from churnlens.operators.ordered import distributed_rank


def group_folds(df: DataFrame, n_splits: int = 5, n_repeats: int = 3, seed: int = cs.SEED,
                group: str = "duplicate_group_id", label: str = cs.TARGET) -> DataFrame:
    """group, repeat, fold (one row per group and repeat)."""
    groups = df.groupBy(group).agg(F.max(F.col(label)).cast("bigint").alias("stratum"))
    reps = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    h = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("repeat")).cast("string"), F.col(group).cast("string")))
    ranked = distributed_rank(reps.withColumn("_h", h), ["_h", group], keys=["repeat", "stratum"], out="_rk")
    return ranked.select(group, F.col("repeat").cast("bigint").alias("repeat"),
                         ((F.col("_rk") - 1) % n_splits).cast("bigint").alias("fold"))


def assign_folds(df: DataFrame, n_splits: int = 5, n_repeats: int = 3, seed: int = cs.SEED,
                 group: str = "duplicate_group_id", label: str = cs.TARGET) -> DataFrame:
    """Rows x repeats with their validation fold (joined back on the group id)."""
    g = group_folds(df, n_splits, n_repeats, seed, group, label)
    return df.join(g, group)


def holdout_split(df: DataFrame, seed: int = cs.SEED, group: str = "duplicate_group_id",
                  label: str = cs.TARGET) -> DataFrame:
    """~20 % test set: the first of five stratified grouped folds with seed + 1000."""
    g = group_folds(df, 5, 1, seed + 1000, group, label).select(group, (F.col("fold") == 0).alias("is_test"))
    return df.join(g, group)


def fold_integrity(folds: DataFrame, holdout: DataFrame | None = None, row: str = cs.CLEAN_ID,
                   group: str = "duplicate_group_id") -> DataFrame:
    """Violation counts (all must be 0): rows not validated exactly once per repeat; groups whose
    rows sit in more than one fold; rows in both the holdout and the development set."""
    per_row = folds.groupBy("repeat", row).agg(F.count(F.lit(1)).alias("n"))
    per_group = folds.groupBy("repeat", group).agg(F.countDistinct("fold").alias("nf"))
    a = per_row.agg(cond_count(F.col("n") != 1).alias("rows_not_once"))
    b = per_group.agg(cond_count(F.col("nf") > 1).alias("groups_split"))
    out = a.unionByName(b, allowMissingColumns=True)
    if holdout is not None:
        both = holdout.groupBy(row).agg(F.countDistinct("is_test").alias("k"))
        out = out.unionByName(both.agg(cond_count(F.col("k") > 1).alias("rows_in_both")), allowMissingColumns=True)
    return out.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in out.columns])


def label_shuffle(df: DataFrame, seed: int = cs.SEED, row: str = cs.CLEAN_ID, label: str = cs.TARGET) -> DataFrame:
    """Permute the label: the row with the r-th smallest id takes the label of the row with the r-th
    smallest md5(seed:id). Two distributed ranks and an equi-join on rank."""
    by_id = distributed_rank(df.select(row), [row], out="r")
    by_hash = distributed_rank(df.select(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row))).alias("_h"), row, label),
                               ["_h", row], out="r")
    return by_id.join(by_hash.select("r", F.col(label).alias(f"{label}_shuffled")), "r").select(row, f"{label}_shuffled")
