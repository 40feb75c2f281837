"""Operator 11 against scoring every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from churnlens.llm import stratified_index as si

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(_LOW))


def brute_force(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_words = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            n = sum(bag.values())
            m = 75 + 25 * n * n_docs // max(n_words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def tables():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "ÉTÉ", "été", "a1", "x"]
    draw = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words[:1 + int(66 * rnd.random() ** 2)]) for _ in range(n))
    docs = [(k, draw(rnd.choice([1, 3, 3, 9, 20, 80]))) for k in range(400)]
    docs += [(1000 + k, "hot copy of the same w1 text") for k in range(200)]  # ties, in one stratum
    docs += [(7, draw(5)), (None, "w1 w2 w3"), (None, None), (2000, ""), (2001, " .;! "), (2002, "w5 " * 30_000), (2003, None)]
    items = [(k, draw(rnd.randrange(1, 30))) for k in range(25)] + [(100, "hot copy"), (101, None), (102, "!"), (103, "nowhere at all"), (104, "the the THE the w1")]
    return docs, items


@pytest.mark.parametrize("part_words", [si.PART_WORDS, 500])
def test_equals_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(si, "PART_WORDS", part_words)
    docs, items = tables()
    d = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id long, text string, item_id string, score double").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert sorted((tuple(r) for r in si.search(d, q).collect()), key=str) == brute_force(docs, items)


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(si, "BLOCK_TERMS", 40)
    docs, items = tables()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in si.search(d, q, top=3).collect()), key=str) == brute_force(docs, items, 3)


def test_large_weights(spark):
    docs, items = [(1, "a b"), (2, "a"), (3, "c")], [(1, "a " * 40_000_0 + "b " * 300_000)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in si.search(d, q).collect()), key=str) == brute_force(docs, items)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert si.search(none, items).count() == 0
    assert si.search(some, items.limit(0)).count() == 0
    assert si.search(some, items).count() == 1
