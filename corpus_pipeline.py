"""The training-corpus pipeline: each stage reads what its predecessor wrote.

quality classifier -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> SentencePiece.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import decontaminate, jaccard_join, line_templates, rule_ensemble, sentencepiece_unigram
from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored
from churnlens.llm.queries import vocabulary
from churnlens.session import scratch_path
from churnlens.sources.tables import table

BROADCAST_KEYS = 1_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores CUTOFF or higher. The model is trained on the stage's
    own input; held-out ids take no part in it."""
    model = rule_ensemble.train(rule_ensemble.statistics_table(docs), table(spark, sf_dir, "labels"))
    tk.small_batches(spark)
    scored = docs.withColumn("_statistics", rule_ensemble.text_statistics(F.col("text")))
    return scored.where(model.score(F.col("_statistics")) >= rule_ensemble.CUTOFF).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows the text. A document of
    which nothing but blanks is left goes, unless it came so."""
    out = line_templates.drop_templates(docs)
    kept = out.where("n_dropped = 0 or text rlike '[^ \\t\\r\\n]'")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the least id. Rows that repeat a kept row
    in id and text go, too; texts without words link with nothing and stay."""
    found = stored(jaccard_join.near_duplicates(docs), "groups")
    gone = stored(jaccard_join.repeats(found), "repeats")
    keyed = docs.withColumn("_rk", jaccard_join.row_key(F.col("doc_id"), F.col("text")))
    kept = _without(keyed, gone.withColumnRenamed("rk", "_rk"))
    twice = stored(found.groupBy(F.col("rk").alias("_rk")).count().where("count > 1").select("_rk"), "twice")
    if not twice.isEmpty():
        single = keyed.join(twice, "_rk", "left_semi").join(gone.withColumnRenamed("rk", "_rk"), "_rk", "left_anti").dropDuplicates(["_rk"])
        kept = _without(kept, twice).unionByName(single)
    return kept.select(*docs.columns)


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose _rk is not listed; the list is broadcast up to a bound and joined beyond it."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "_rk", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. The text alone decides, so rows with a null id are judged, too."""
    bad = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("tkey").distinct()
    return docs.withColumn("tkey", F.xxhash64("text")).join(bad, "tkey", "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document."""
    return sentencepiece_unigram.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: a trained classifier, hashed templates and Viterbi are no SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
