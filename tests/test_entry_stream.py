from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from churnlens.operators import scoring as sc
from churnlens.plans import pipeline as pl
from churnlens.session import scratch_path
from churnlens.sources import fixtures as fx
from churnlens.sources.tables import TABLES
from churnlens.streaming.scoring import score_stream
from conftest import SF_SMALL


def test_entry_and_registry(spark):
    out = entry.entry(spark).collect()
    assert [r.band for r in sorted(out, key=lambda r: r.band_order)] == ["LOW", "MEDIUM", "HIGH"]
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 75


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return round(v, 9) if isinstance(v, float) else (v.item() if hasattr(v, "item") else v)


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_selected_oracles_at_smoke_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in ("band_summary", "roc_auc", "threshold_sweep", "capacity_table", "segment_rates", "contract_checks_dirty"):
        s = qs[name](spark, SF_SMALL).toPandas()
        o = con.execute(sql[name]).df()
        assert sorted(s.columns) == sorted(o.columns), name
        assert _rows(s) == _rows(o), name


def test_stream_scores_equal_batch(spark):
    path = scratch_path(spark, "stream-src")
    raw = fx.accounts(spark, SF_SMALL).drop(fx.ROW)
    raw.write.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(path)
    m = sc.fixed_account_model()
    q = (score_stream(stream, m, "v1").writeStream.format("memory").queryName("scores_stream")
         .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.customer_id: r.risk_score for r in spark.sql("SELECT * FROM scores_stream").collect()}
    batch = {r.customer_id: r.risk_score for r in pl.scored_accounts(spark, SF_SMALL).collect()}
    assert got == batch
    assert spark.sql("SELECT count_if(NOT row_valid) FROM scores_stream").first()[0] == 0
