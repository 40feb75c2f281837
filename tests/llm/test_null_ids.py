"""Rows without an id: linked, judged and written like any other."""

from __future__ import annotations

import zlib

import numpy as np

from churnlens.llm import decontaminate, jaccard_join, planes
from churnlens.llm.queries import vocabulary
from tests.llm.test_operators import docs_of

WORDS = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]


def near(k):
    return " ".join(WORDS[:k] + ["other"] + WORDS[k + 1:])


def test_null_ids_link(spark):
    other = " ".join(reversed(WORDS))
    rows = [(None, " ".join(WORDS)), (None, near(99)), (7, near(0)), (None, other), (None, other + " end"), (9, "alone in this table with no copy"), (None, None), (None, "")]
    got = jaccard_join.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        if r.component is not None:
            groups.setdefault(r.component, []).append((r.doc_id, r.component_id))
    assert sorted(map(len, groups.values())) == [1, 2, 3]
    ids = {len(g): {c for _, c in g} for g in groups.values()}
    assert ids == {3: {7}, 2: {None}, 1: {9}}


def test_null_ids_are_judged(spark):
    item = " ".join(WORDS[:20])
    rows = [(None, f"see {item} now"), (None, f"see {item} now"), (None, "nothing of it"), (None, None), (3, f"so {item}"), (4, "")]
    bench = spark.createDataFrame([(1, item), (2, " ".join(WORDS[30:50]))], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs_of(spark, rows), bench).collect()))
    assert got == [(0, 0, 0, 0, False), (0, 3, 0, 0, False), (0, 22, 20, 1, True), (0, 22, 20, 1, True), (3, 21, 20, 1, True), (4, 0, 0, 0, False)]


def test_null_ids_are_written(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(None, "a text without id"), (None, None), (0, "number zero"), (-5, "less than zero")]
    got = sorted(planes.token_files(docs_of(spark, rows), path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -5, 0]  # nulls come first

    def crc(text):
        return zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())

    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(x)) for i, x in rows)
