"""Operators against brute force and their edge cases: nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import (
    decontaminate,
    host_reputation,
    jaccard_join,
    line_templates,
    pii_spans,
    planes,
    pseudo_likelihood,
    repetition,
    rule_ensemble,
    sentencepiece_unigram,
)
from churnlens.llm.queries import vocabulary

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 997}" for k in range(60_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
ROWS = [
    (0, None), (1, ""), (2, " \n\t "), (3, BASE), (4, BASE), (4, BASE), (5, BASE + " extra"), (6, "one two"), (7, "One TWO"), (8, "one"),
    (9, LONG), (10, "É ñ ☃ 𓀀 thing's <|endoftext|> a.b\r\nc  d"), (11, "same line of five words\nsame line of five words\nother"),
    (12, "call +1 (743) 555-3824 or mail a.b@c.example.com, 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111 x"), (13, "go go go go go go go go go go")]


def docs_of(spark, rows):
    """A documents-like table with columns whose names clash with inner ones."""
    full = [(i, t, "en", "src", 0 if t is None else len(t), 1, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n int, tokens string")


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_jaccard_components_match_brute_force(spark, docs, empty):
    sets = {}
    for i, t in ROWS:
        w = SPACED.findall(lower(t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                least[b] = min(least[b], least[a])
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), least[i]) for i, s in sets.items()}
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_joins_a_large_group_of_near_copies(spark):
    words = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(300):
        w = list(words)
        w[(7 * i) % 200] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_jaccard_tries_few_pairs_in_a_group_that_hardly_links(spark, monkeypatch):
    """Most copies with three changes each are too far apart to link, but share nearly all shingles; some have a copy of their own."""
    rng = np.random.default_rng(1)
    words = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(300):
        w = list(words)
        for j, at in enumerate(rng.choice(150, 3, replace=False)):
            w[at] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
        if i % 20 == 0:
            w[(7 * i + 25) % 150] = f"more{i}"
            rows.append((1000 + i, " ".join(w)))
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    expected = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and expected[a] != expected[b]:
                low, high = sorted((expected[a], expected[b]))
                expected = {i: low if c == high else c for i, c in expected.items()}
    assert len(set(expected.values())) > 100
    tried, stored = [], jaccard_join.stored

    def counted(rows, name):
        out = stored(rows, name)
        if name == "pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "FEW", 8, raising=False)  # the group is small
    got = jaccard_join.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert sum(tried) < 20 * len(rows), tried


def test_difference_prefixes_keep_every_link():
    """Random families around a leader: sets that link, but not both with the leader, meet in their prefixes."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        leader = set(range(int(rng.integers(4, 60))))
        first = {t for t in leader if rng.random() > 0.2} | set(range(100, 100 + int(rng.integers(0, 8))))
        x = {t for t in first if rng.random() > 0.05} | {200}
        y = {t for t in first if rng.random() > 0.05} | set(range(300, 300 + int(rng.integers(0, 3))))
        near = [10 * len(s & leader) >= 8 * len(s | leader) for s in (x, y)]
        if 10 * len(x & y) < 8 * len(x | y) or all(near):
            continue
        order = rng.permutation(400)
        short, long = sorted((sorted(s ^ leader, key=lambda t: order[t]) for s in (x, y)), key=len)
        of = {id(d): s for s in (x, y) for d in (short, long) if set(d) == s ^ leader}
        p = jaccard_join.difference_prefixes(len(long), len(of[id(long)]), len(leader))[0]
        q = jaccard_join.difference_prefixes(len(short), len(of[id(short)]), len(leader))[1]
        assert set(short[:q]) & set(long[:p])


def test_repetition_counts_match_brute_force(docs, empty):
    def brute(t):
        w = SPACED.findall(t)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        times = Counter(grams)
        cover = {j for k, g in enumerate(grams) if times[g] > 1 for j in range(k, k + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)

    got = repetition.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter(
        (i, *brute(t or "")) for i, t in ROWS)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert repetition.quality_rules(empty).count() == 0


def test_decontamination_matches_brute_force(spark, docs, empty):
    items = [(1, BASE), (2, "one two"), (3, None), (4, "... !"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t or ""))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(i)

    def brute(t):
        w, hit, found = word.findall(lower(t or "")), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= ids
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    got = decontaminate.contamination(docs, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, *brute(t)) for i, t in ROWS)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_proximity_match(spark):
    bench = spark.createDataFrame([(1, "rare1 common rare2")], "item_id long, text string")
    d = docs_of(spark, [(1, "rare2 x x rare1 common"), (2, "rare1 " + "common " * 60 + "rare2"), (3, "rare1 common rare2")])
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination(d, bench).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (3, 0)}


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files_round_trip(docs, empty, mode):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(planes.token_files(docs, path, mode).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in ROWS)
    texts, at = dict(ROWS), 0
    for r in got:
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert planes.token_files(empty, path, mode).count() == 0


def test_shard_index_reads_ranges():
    import io

    out, rng = io.BytesIO(), np.random.default_rng(3)
    ids = rng.integers(0, 2**32, 200_001, dtype=np.uint32)
    w = planes.ShardWriter(out, "bit")
    w.add(np.array([1, 2]), np.array([100_000, 100_001]), ids)
    w.close()
    reader = planes.ShardReader(out, len(out.getvalue()))
    assert np.array_equal(reader.ids(65_530, 131_080), ids[65_530:131_080])
    assert reader.checksums().tolist() == [zlib.crc32(ids[:100_000].tobytes()), zlib.crc32(ids[100_000:].tobytes())]


def test_sentencepiece_round_trip_and_edges(docs, empty):
    path = vocabulary("piece_bpe_32k.model")
    encoded = sentencepiece_unigram.encode_documents(docs, path)
    got = encoded.collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    assert {(r.doc_id, r.text) for r in sentencepiece_unigram.decode_documents(encoded, path).collect()} == {(i, t or "") for i, t in ROWS}
    assert sentencepiece_unigram.encode_documents(empty, path).count() == 0


def test_viterbi_is_optimal():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "<0xC3>", "<0xA9>"]
    scores = [0.0, -3.0, -3.5, -4.0, -5.0, -9.0, -2.0, -4.5, 0.0, 0.0]
    v = sentencepiece_unigram.Vocabulary.of(pieces, scores, {0}, {8, 9}, 0)
    e = sentencepiece_unigram.Encoder(v)

    def best(t):
        if not t:
            return 0.0
        return max(scores[k] + best(t[len(pieces[k]):]) for k in range(1, 8) if t.startswith(pieces[k]))

    rng = np.random.default_rng(5)
    for _ in range(60):
        t = "▁" + "".join(rng.choice(list("ab"), rng.integers(1, 12)))
        for raw in (e.one(t.encode()), e.many([t.encode()])[0]):
            ids = np.frombuffer(raw, "<i4").tolist()
            assert "".join(pieces[i] for i in ids) == t and sum(scores[i] for i in ids) == pytest.approx(best(t))
    assert np.frombuffer(e.one("é".encode()), "<i4").tolist() == [8, 9]


def test_personal_data(docs, empty):
    got = {r.doc_id: r for r in pii_spans.personal_data(docs).collect()}
    r, t = got[12], dict(ROWS)[12]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    base = [x.split(":") for x in r.spans.split(",")][:4]
    assert [(k, t[int(a):int(b)]) for k, a, b in base] == [
        ("email", "a.b@c.example.com"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert hashlib.sha256(",".join(":".join(x) for x in base).encode()).hexdigest() == r.base_sha256
    assert got[0].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii_spans.personal_data(empty).count() == 0


def test_personal_data_adds_secrets(spark):
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows = [(i, f'words here token = "{secret[i:] + secret[:i]}" more') for i in range(8)]
    rows += [(100 + i, "a-very-long-hyphenated-word-without-any-meaning here") for i in range(8)]
    got = pii_spans.personal_data(docs_of(spark, rows)).collect()
    assert all(("secret:20:60" in r.spans) == (r.doc_id < 100) and (r.spans == "") == (r.doc_id >= 100) for r in got)


def test_labeler_reliabilities_are_estimated():
    share, odds = pii_spans.estimate([((1, 1, 1), 60), ((1, 1, 0), 30), ((0, -1, -1), 80), ((1, -1, -1), 10)])
    assert 0.3 < share < 0.7 and odds[1][1][0] > odds[1][1][1]
    assert pii_spans.posterior(share, odds, (1, 1, 1)) > 0.95 > 0.05 > pii_spans.posterior(share, odds, (0, -1, -1))


def test_line_templates(spark, empty):
    rows = [(i, f"intro of document number{'x' * i} with words\nSold by unit {i} of the great shop on 0{i}.11.2020 today\nend{i}") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "Of.\nOf."), (23, rows[0][1]), (23, rows[0][1])]
    got = line_templates.drop_templates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"n_lines", "n_dropped", "tokens", "n"}
    by = {r.doc_id: r for r in got}
    assert by[0].n_dropped == 0 and "Sold by" in by[0].text
    assert all(by[i].n_dropped == 1 and by[i].text.count("\n") == 1 and "Sold" not in by[i].text for i in range(1, 8))
    assert by[20].text is None and by[20].n_lines == 0 and by[21].text == "" and by[22].text == "Of.\nOf."
    assert by[23].n_dropped == 1
    assert line_templates.drop_templates(empty).count() == 0


def test_line_templates_generalise_words(spark):
    names = ["anna", "boris", "clara", "dora", "emil", "frida", "georg", "hanna"]
    rows = [(i, f"thank you for visiting our lovely little page dear {n} and come back soon\nbody {i}") for i, n in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_templates(docs_of(spark, rows)).collect()}
    assert got == {0: 0} | {i: 1 for i in range(1, 8)}


def dropped(spark, rows):
    return {r.doc_id for r in line_templates.drop_templates(docs_of(spark, rows)).collect() if r.n_dropped}


def test_line_templates_drop_long_lines_from_the_second_text(spark):
    def line(name, n):
        return " ".join(f"{name}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))

    shared = [("p", 50, 2), ("q", 60, 3), ("r", 80, 4), ("s", 49, 4), ("t", 49, 5)]
    rows, want = [], set()
    for name, n, texts in shared:
        ids = range(len(rows), len(rows) + texts)
        rows += [(i, f"{line(name, n)}\nown {'x' * (i + 1)}") for i in ids]
        want |= set(ids[1:]) if n >= 50 or texts >= 5 else set()
    edited = line("u", 60)  # two long lines that differ in one word
    rows += [(90, edited + "\nbody"), (91, edited.replace("ubz", "other") + "\nrest")]
    rows += [(95, line("v", 55) + "\nsame"), (96, line("v", 55) + "\nsame")]  # copies are one text
    assert dropped(spark, rows) == want | {91}


def test_line_templates_find_all_templates_of_a_leaf(spark):
    names = ["anna", "boris", "clara", "dora", "emil", "frida", "georg", "hanna"]
    one = [(i, f"thank you for your visit to our lovely page dear {n} come back soon\na {'x' * i}") for i, n in enumerate(names)]
    two = [(10 + i, f"thank you for your order of one new phone mister {n} see it online\nb {'x' * i}") for i, n in enumerate(names)]
    noise = [(30 + i, "thank you for your " + " ".join(f"{n}{c}" for c in "abcdefghij") + f"\nc {'x' * i}") for i, n in enumerate(names)]
    assert dropped(spark, one + two + noise) == {*range(1, 8), *range(11, 18)}


def test_line_templates_match_variants_of_a_common_line(spark):
    first, second = "all rights to this text are kept by the people who wrote it", "all rights to this page and its many fine words remain with us"
    rows = [(i, f"{first}\nd {'x' * i}") for i in range(6)] + [(10 + i, f"{second}\ne {'x' * i}") for i in range(6)]
    rows += [(20, first.replace("people", "person") + "\nf"), (21, second.replace("page", "book") + "\ng"), (22, first.replace("text", "note") + "\nh")]
    rows += [(30, "all rights to this " + " ".join(f"z{c}" for c in "abcdefghi") + "\nk")]
    assert dropped(spark, rows) == {*range(1, 6), *range(11, 16), 20, 21, 22}


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/1x", "https://example.org/en/2", "https://x.com/de/1?q", "https://x.com#/de/", None, "no scheme", "ftp://h"]
    pages = [(i, u, "") for i, u in enumerate(urls)] + [(100 + i, "http://bad.net/x", "") for i in range(60)] + [(200 + i, f"http://good{i % 9}.net/x", "") for i in range(200)]
    labels = [(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(200)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = spark.createDataFrame(labels, "page_id long, good int")
    got = {r.page_id: r for r in host_reputation.url_verdicts(p, out).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(8)] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/1x", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"), ("x.com", "/de/1", "com/de/", "block"), ("x.com", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow")]
    assert got[100].verdict == "block" and got[200].verdict == "allow"
    assert host_reputation.url_verdicts(p.limit(0), out).count() == 0
    assert {r.verdict for r in host_reputation.url_verdicts(p.where("page_id >= 100"), out.limit(0)).collect()} == {"allow"}


def test_pseudo_likelihood_prefers_the_language_it_saw(spark, docs, empty):
    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(docs).collect()}
    assert got[0].log_prob == 0 and got[1].mean_log_prob is None and got[9].log_prob < 0
    assert pseudo_likelihood.pseudo_likelihood(empty).count() == 0


def test_pseudo_likelihood_matches_direct_sum():
    w = pseudo_likelihood.first_weights(np.ones(pseudo_likelihood.CLASSES))
    ids = np.array([3, 5, 3, 7])
    around = pseudo_likelihood.windows(ids, np.array([0, 3, 4]))
    assert around.tolist() == [[256, 256, 5, 3], [256, 3, 3, 256], [3, 5, 256, 256], [256, 256, 256, 256]]
    direct = []
    for i, a in zip(ids, around, strict=True):
        h = np.tanh(w[0][a].ravel() @ w[1] + w[2])
        g, m = divmod(i, pseudo_likelihood.MEMBERS)
        z, y = h @ w[3] + w[4], h @ w[5][g] + w[6][g]
        direct.append(z[g] - np.log(np.exp(z).sum()) + y[m] - np.log(np.exp(y).sum()))
    assert np.allclose(pseudo_likelihood.log_probs(w, ids, around), direct, atol=1e-4)
    every = np.arange(pseudo_likelihood.CLASSES)
    for a in around:
        assert np.isclose(np.exp(pseudo_likelihood.log_probs(w, every, np.tile(a, (len(every), 1)))).sum(), 1, atol=1e-4)


def test_pseudo_likelihood_steps_follow_the_gradient():
    """A first Adagrad step moves each weight by the sign of its slope, as differences show it."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, pseudo_likelihood.CLASSES, 40)
    around = pseudo_likelihood.windows(ids, np.array([0, 25, 40]))
    w = [x.astype(np.float64) for x in pseudo_likelihood.first_weights(np.ones(pseudo_likelihood.CLASSES))]
    stepped, seen = [x.copy() for x in w], [np.zeros_like(x) for x in w]
    pseudo_likelihood.train_step(stepped, seen, ids, around)
    for k, x in enumerate(w):
        for at in zip(*(rng.integers(0, n, 6) for n in x.shape), strict=True):
            moved = [[y.copy() for y in w] for _ in range(2)]
            for m, d in zip(moved, (1e-5, -1e-5), strict=True):
                m[k][at] += d
            up, down = (-pseudo_likelihood.log_probs(m, ids, around).mean() for m in moved)
            slope = (up - down) / 2e-5
            assert np.isclose(np.sqrt(seen[k][at]), abs(slope), atol=1e-6)
            assert abs(slope) < 1e-4 or np.sign(w[k][at] - stepped[k][at]) == np.sign(slope)
    for _ in range(60):
        pseudo_likelihood.train_step(stepped, seen, ids, around)
    assert pseudo_likelihood.log_probs(stepped, ids, around).mean() > pseudo_likelihood.log_probs(w, ids, around).mean() + 1


def test_pseudo_likelihood_rounds_train_on_every_word():
    ids, bounds = np.zeros(5000, dtype=np.int64), np.array([0, 7, 7, 1200, 5000])
    parts = [pseudo_likelihood.masked(ids, bounds, k) for k in range(pseudo_likelihood.ROUNDS)]
    assert sorted(np.concatenate(parts).tolist()) == list(range(5000)) and min(map(len, parts)) > 2000


@pytest.mark.parametrize("known", [1, 500, 1 << 18])
def test_pseudo_likelihood_scores_words_within_their_class(spark, monkeypatch, known):
    """Words of one shared class differ by their counts, wherever they are looked up."""
    monkeypatch.setattr(pseudo_likelihood, "KNOWN", known)
    words = [f"w{k}" for k in range(3000)]
    table = Counter({w: 1 + 4000 // (k + 1) for k, w in enumerate(words)})
    rows = [(i, " ".join(w for w in words[i::7] for _ in range(table[w]))) for i in range(7)] + [(7, None), (8, " "), (9, words[-1].upper()), (9, words[-1])]
    table[words[-1]] += 2
    d = docs_of(spark, rows).repartition(3)
    counted = pseudo_likelihood.word_table(pseudo_likelihood.tk.texts(d))
    hashes = dict(zip(pseudo_likelihood.tk.hash_words(words).tolist(), words, strict=True))
    assert {hashes[r.word % (1 << 64)]: r.n for r in counted.collect()} == table
    known_words, sizes = pseudo_likelihood.lexicon(counted)
    h = pseudo_likelihood.tk.hash_words(words)
    classes = known_words.classes(h)
    direct = np.bincount(classes, [table[w] for w in words], pseudo_likelihood.CLASSES)
    assert np.array_equal(sizes, direct) and sizes.sum() == sum(table.values())
    monkeypatch.setattr(pseudo_likelihood, "train", lambda *a: pseudo_likelihood.first_weights(sizes))
    got = sorted(pseudo_likelihood.pseudo_likelihood(d).collect(), key=lambda r: r.doc_id)
    w = pseudo_likelihood.first_weights(sizes)
    place = {x: k for k, x in enumerate(words)}
    for r, (i, text) in zip(got, rows, strict=True):
        at = np.array([place[x.lower()] for x in (text or "").split()], dtype=np.int64)
        ids = classes[at]
        each = pseudo_likelihood.log_probs(w, ids, pseudo_likelihood.windows(ids, np.array([0, len(ids)])))
        within = np.log([table[words[k]] / direct[c] for k, c in zip(at, ids, strict=True)])
        assert (r.doc_id, r.n_tokens) == (i, len(at)) and np.isclose(r.log_prob, each.sum() + within.sum(), rtol=1e-6)


def test_rule_ensemble(spark, docs, empty):
    good = "plain words make a sentence here and there with some more of them in a line"
    rows = [(i, f"{good} {i}") if i % 2 else (i, f"x*** y$$$ z### {i}&&& " * 6) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = rule_ensemble.quality_scores(docs_of(spark, [*rows, (900, None), (901, "")]), labels).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert {r.score for r in rule_ensemble.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.quality_scores(empty, labels).count() == 0
