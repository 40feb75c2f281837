"""Operator 13 against counting every gram in plain Python."""

from __future__ import annotations

import collections
import random
import re

import pytest

from churnlens.llm import collocations as co

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, first):
    grams, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    grams[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, g in grams.items():
        cands = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        held = {p[i:i + m] for p, a in cands.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * cands[p[i:i + m]]}
        scored = []
        for p, a in cands.items():
            if p not in held:
                score, _, left, right = min((2000000 * a // (g[p[:k]] + g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:first])]
    return sorted(out)


def _rows():
    rnd = random.Random(5)
    words = ["the", "of", "Red", "fox", "en", "es", "Ünï", "a-b", "x y", "ha"]
    rows = [(rnd.choice(["en", "es", None, "und", ""]), " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(rnd.randrange(40)))) for _ in range(150)]
    rows += [("en", "one long passage that comes again and again in many texts")] * 7 + [("en", None), (None, ""), ("fr", "  \t "), ("fr", ".;!")]
    rows += [("en", "ha " * 50), ("en", "tick tock " * 30), ("de", "rare words here")] + [("en", "word " * 3000 + "end")]
    return rows


@pytest.mark.parametrize(("least", "first"), [(3, 2000), (30, 2000), (4, 5)])
def test_equals_brute_force(spark, least, first):
    rows = _rows()
    docs = spark.createDataFrame([(lang, text, "x", None) for lang, text in rows], "lang string, text string, phrase string, n long").repartition(5)
    got = sorted(tuple(r) for r in co.collocations(docs, least=least, first=first).collect())
    assert got == brute_force(rows, least, first) and got


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_unary_paths(spark):
    # a chain a-b-c-d, a fork at d, a circle p-q-r that nothing enters, a loop
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "s")]
    edges = spark.createDataFrame([("en", u, v, 9) for u, v in pairs], "lang string, src string, dst string, w long")
    rows = {(r.src, r.dst): r for r in co.unary_paths(edges).collect()}
    assert len(rows) == len(pairs)
    assert rows["a", "b"].path == rows["b", "c"].path == rows["c", "d"].path
    assert [rows[x].dist for x in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"))] == [2, 1, 0, 0]
    alone = [rows[x] for x in pairs[3:]]
    assert len({r.path for r in alone} | {rows["a", "b"].path}) == len(alone) + 1 and not any(r.dist for r in alone)
