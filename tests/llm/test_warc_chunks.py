"""Operator 12: archives against the rows that were written."""

from __future__ import annotations

import gzip
import hashlib
import io
import os

import pytest

from churnlens.llm import warc_chunks as wc

LONG = "é" * 700_000
PAGES = [
    (5, "http://a.org/x y\r\nWARC-Type: x", "same " * 40), (3, "http://b.org/", "same " * 40), (9, None, "same " * 40), (3, "http://b.org/", "same " * 40),
    (7, "", "short"), (2, "u", "short"), (1, "u", None), (4, "u", ""), (None, "u", "no id " * 30), (None, "u", "no id " * 30), (6, "u", "no id " * 30),
    (None, "u", "only null ids " * 20), (None, None, "only null ids " * 20), (10, "u", LONG), (11, "u", LONG), (12, "u", "a\r\n\r\nb" * 50), (13, "u", "x" * 99), (14, "u", "x" * 99),
    (15, "u", "y" * 100), (16, "u", "y" * 100), (17, "u", "z" * wc.CHUNK), (18, "u", "z" * (wc.CHUNK + 1)),
]


def expected(pages):
    first: dict[bytes, tuple] = {}
    for page, _, html in pages:
        raw = (html or "").encode()
        key = (page is None, page or 0)
        if len(raw) >= 100 and key < first.get(raw, (2,)):
            first[raw] = key
    out, used = [], set()
    for page, _, html in pages:
        raw = (html or "").encode()
        top = (page is None, page or 0) == first.get(raw) and raw not in used
        used |= {raw} if top else set()
        revisit = raw in first and not top
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", None if not revisit or first[raw][0] else first[raw][1]))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, uid int").repartition(3)


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    got = sorted((tuple(r) for r in wc.archive_pages(frame(spark, PAGES), folder).collect()), key=str)
    assert got == expected(PAGES)
    raw = b"".join(gzip.open(f"{tmp_path}/warc/{n}").read() for n in sorted(os.listdir(f"{tmp_path}/warc")))
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES)
    assert raw.count(b"\r\nWARC-Type: x") == 0
    assert LONG.encode() in raw and raw.count(("same " * 40).encode()) == 1


def test_chunks_carry_running_digests(spark):
    rows = wc.chunk_table(frame(spark, PAGES), size=1000).orderBy("uid", "chunk").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.uid, []).append(r)
    assert len(by) == len(PAGES)
    for parts in by.values():
        whole = b""
        for k, r in enumerate(parts):
            whole += bytes(r.data)
            assert r.chunk == k and len(r.data) <= 1000 and r.bytes == len(whole) and r.digest == hashlib.sha256(whole).hexdigest()
            assert r.last == (k == len(parts) - 1)


def test_reader_pieces_and_faults():
    out = io.BytesIO()
    w = wc.ArchiveWriter(out)
    payloads = [b"", b"q" * 10, os.urandom(5000), b"\r\n\r\n" * 9]
    for k, p in enumerate(payloads):
        d = hashlib.sha256(p).hexdigest()
        w.open(k, k, "u", len(p), d, "response", None, None)
        w.chunk(k, p, d)
    w.close()
    for piece in (1, 7, 4096):
        rows = list(wc.read_records(io.BytesIO(out.getvalue()), piece))
        assert [(r[0], r[2], r[3]) for r in rows] == [(k, len(p), hashlib.sha256(p).hexdigest()) for k, p in enumerate(payloads)]
    with pytest.raises(ValueError):
        list(wc.read_records(io.BytesIO(out.getvalue()[:-3])))
    w.open(9, 9, "u", 4, "0", "response", None, None)
    with pytest.raises(ValueError):
        w.chunk(9, b"abcd", "0")


def test_empty_table(spark):
    assert wc.archive_pages(frame(spark, [])).count() == 0
