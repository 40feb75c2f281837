"""Rows that cost much each are dealt over tasks, whatever splits the reader makes of their table."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.sources import fixtures as fx
from churnlens.sources.tables import table


def test_accounts_of_one_file_are_made_by_several_tasks(spark, tmp_path):
    keys = 2 * fx.TASK_ROWS + 7
    spark.range(keys).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    made = fx.accounts(spark, str(tmp_path))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == keys and max(sizes) <= fx.TASK_ROWS
    assert made.select(fx.ROW).distinct().count() == keys


def test_spread_keeps_repeated_and_null_rows(spark):
    rows = spark.createDataFrame([(None,), (1,), (1,)], "k long")
    assert sorted(map(str, fx.spread(rows).collect())) == sorted(map(str, rows.collect()))
