from __future__ import annotations

import hashlib
import os

import pytest

from churnlens.operators import features as ft
from churnlens.operators import models as md
from churnlens.operators import scoring as sc
from churnlens.plans import pipeline as pl
from churnlens.session import scratch_path
from churnlens.sources import files as io
from churnlens.sources import fixtures as fx
from churnlens.sources import registry as rg
from conftest import SF_SMALL, account


def test_csv_roundtrip_keeps_blanks(spark, raw_df):
    rows = [account(1, tenure="0", TotalCharges=" "), account(2)]
    df = raw_df(rows).drop("_row")
    path = io.write_csv(df, scratch_path(spark, "csv"), single_file=True, order_by=["customerID"])
    back = io.read_raw_csv(spark, path).orderBy("customerID").collect()
    assert back[0].TotalCharges == " " and back[1].TotalCharges == account(2)["TotalCharges"]


def test_file_fingerprint_normalises_crlf(spark):
    d = scratch_path(spark, "fp")
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/a.csv", "wb") as fh:
        fh.write(b"x,y\r\n1,2\r\n")
    got = io.file_fingerprint(spark, f"{d}/a.csv").first().sha256_lf_normalised
    assert got == hashlib.sha256(b"x,y\n1,2\n").hexdigest()


def test_file_fingerprint_chains_blocks_of_any_bytes(spark):
    """Several blocks a file, CRs at block ends, no final line end, a byte order mark, bytes that are no text."""
    d = scratch_path(spark, "fp-many")
    os.makedirs(d, exist_ok=True)
    line = b"some,cells,of,a,row,%d\r\n"
    contents = {
        "blocks": b"".join(line % i for i in range(40_000)), "lf": b"x,y\n1,2\n", "open": b"x,y\r\n1,2", "cr": b"x\ry\r\nz\r", "bom": b"\xef\xbb\xbfx,y\r\n1,2\r\n",
        "bom_open": b"\xef\xbb\xbfx", "bytes": bytes(range(256)) + b"\n\xff\xfe\n\n\n", "empty": b"", "blank": b"\r\n",
    }
    for name, data in contents.items():
        with open(f"{d}/{name}.csv", "wb") as fh:
            fh.write(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65537")
    try:
        got = {os.path.basename(r.path).removesuffix(".csv"): r.sha256_lf_normalised for r in io.file_fingerprint(spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: hashlib.sha256(c.replace(b"\r\n", b"\n")).hexdigest() for n, c in contents.items() if c}


def test_json_is_canonical_at_every_depth(spark):
    df = spark.sql("""SELECT 1 AS z, named_struct('b', 2, 'a', array(named_struct('y', CAST(NULL AS INT), 'x', 1.5D))) AS n, map('q', 1, 'c', 2) AS m
                      UNION ALL SELECT NULL, NULL, map()""")
    path = io.write_json(df, scratch_path(spark, "json"), single_file=True)
    lines = {r.value for r in spark.read.text(path).collect()}
    assert lines == {'{"m":{"c":2,"q":1},"n":{"a":[{"x":1.5,"y":null}],"b":2},"z":1}', '{"m":{},"n":null,"z":null}'}


def test_table_fingerprint_is_order_independent(spark):
    a = fx.accounts(spark, SF_SMALL).drop(fx.ROW)
    f1 = io.table_fingerprint(a, a.columns).first()
    f2 = io.table_fingerprint(a.repartition(7).orderBy("Churn"), a.columns).first()
    assert f1 == f2


def test_model_save_load_roundtrip(spark):
    m = sc.fixed_account_model()
    path = scratch_path(spark, "model")
    meta = rg.model_metadata(spark, "churn-lr-x", "logistic_regression", {"C": 1.0}, 42, "fp", 150,
                             ft.DEFAULT_SPEC, sc.fixed_reference_profile(m.pre)).first().asDict()
    rg.save_model(spark, m, meta, path)
    m2, meta2 = rg.load_model(spark, path)
    f = pl.account_features(spark, SF_SMALL)
    a = {r.customer_id: r.risk_score for r in sc.predict_scores(f, m).collect()}
    b = {r.customer_id: r.risk_score for r in sc.predict_scores(f, m2).collect()}
    assert a == b and meta2["model_version"] == "churn-lr-x"
    try:
        rg.load_model(spark, scratch_path(spark, "missing"))
    except FileNotFoundError:
        pass
    else:
        raise AssertionError


def test_prepare_writes_both_tables(spark):
    out = scratch_path(spark, "prepare")
    c, f = rg.prepare(fx.accounts(spark, SF_SMALL), out)
    assert spark.read.parquet(c).count() == 150 and len(spark.read.parquet(f).columns) == 21


def test_unknown_model_name_raises():
    with pytest.raises(KeyError):
        md.fit_tree(None, "svm")
