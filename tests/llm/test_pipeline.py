"""The pipeline's stages keep the columns, take effect, and chain as run() does."""

from __future__ import annotations

import corpus_pipeline
from churnlens.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > 0 and sizes[3] < sizes[2]
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_jaccard_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(5, text), (3, text), (3, text), (9, text + " x"), (1, None), (2, ""), (7, "other words entirely")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.jaccard_dedup(spark, docs, SF).collect())
    assert got == [1, 2, 3, 7]
