"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: a table of up to so many links is written by one task and its least neighbours are broadcast
SMALL = 100_000


def _with_least(edges: DataFrame, small: bool) -> DataFrame:
    """Each edge (u, v) with the smallest node among u and all its neighbours. The minimum is a
    partial aggregate and the join back can be split, so a node with many links is no hot task."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(F.broadcast(least) if small else least, "u")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``links`` (columns u, v); component is the least node.

    Alternating large-star and small-star steps, each stored; the number of steps grows with the
    logarithm of the largest component, not with its size."""
    small = links.count() <= SMALL

    def kept(rows: DataFrame) -> DataFrame:
        return stored(rows.coalesce(1) if small else rows, "edges")

    edges = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, small).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = _with_least(large, small)
        star = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        edges = kept(star.where("u <> v").distinct())
        # settled when every edge goes from a node of one edge to a centre that has none of its own
        again = edges.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("c")).unionByName(
            edges.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).alias("n"), F.lit(1).alias("c")))
        if again.groupBy("u").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).where("n + c > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
