"""Line dedup against a plain-Python version, on planted cases."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from churnlens.llm import line_templates as lt
from tests.llm.test_operators import docs_of


def masked(line):
    return tuple("<*>" if any("0" <= c <= "9" for c in t) else t for t in line.replace("\t", " ").replace("\r", " ").split(" ") if t)


def enough(n):
    return lt.LONG_DOCS if n >= lt.LONG_TOKENS else lt.MIN_DOCS


def first_and_texts(lines, weight):
    per = defaultdict(list)
    for x in lines:
        per[x[1]].append(x)
    return min(x for x in lines), sum(max(weight.get(x, 1) for x in v) for v in per.values())


def plain(rows):
    """(doc_id, line number) of the lines to drop; lines are (doc_id, text, number)."""
    words = {}
    for i, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if len(masked(line)) >= lt.MIN_TOKENS:
                words[(i, text, no)] = masked(line)
    gone, weight, loose, by = set(), {}, [], defaultdict(list)
    for x, w in words.items():
        by[w].append(x)
    for w, group in by.items():
        first, texts = first_and_texts(group, {})
        if texts >= enough(len(w)):
            gone |= {x for x in group if x[:2] != first[:2]}
            weight[first] = texts
        else:
            loose += group
    groups = defaultdict(list)
    for x in loose + list(weight):
        groups[len(words[x]), words[x][:lt.LEADING]].append(x)
    todo, top = list(groups.values()), True
    while todo:
        after, taken, rest = {}, set(), []
        for group in todo:
            n, total = len(words[group[0]]), sum(weight.get(x, 1) for x in group)
            if all(x in weight for x in group) or total < enough(n):
                continue
            cells = defaultdict(list)
            for x in group:
                for p, t in enumerate(words[x]):
                    cells[p, t].append(x)
            times = {c: sum(weight.get(x, 1) for x in v) for c, v in cells.items()}
            near = [x for x in group if sum(2 * times[p, t] > total for p, t in enumerate(words[x])) >= lt.SIMILAR * n]
            if near and first_and_texts(near, weight)[1] >= enough(n):
                gone |= {x for x in near if x not in weight and x[:2] != min(near)[:2]}
                taken |= {x for x in near if x not in weight}
            rest.append((group, n, total, cells, times))
        for k, (group, n, total, cells, times) in enumerate(rest):
            for x in set(group) - taken:
                own = sorted((times[c], c[0], frozenset(cells[c])) for c in enumerate(words[x]) if enough(n) <= times[c] < total)
                for _, _, members in own[:n - math.ceil(lt.SIMILAR * n) + 1 if top else 1]:
                    after.setdefault((k, members), set()).add(x)
        todo, top = [sorted(v) for v in after.values()], False
    return Counter(i for i, _, _ in gone)


def check(spark, rows):
    want = plain(rows)
    got = {r.doc_id: r.n_dropped for r in lt.drop_templates(docs_of(spark, rows)).collect() if r.n_dropped}
    assert got == dict(want)
    return got


NAMES = ["anna", "boris", "clara", "dora", "emil", "frida"]


def many_templates(count, seed=1):
    rnd, rows = random.Random(seed), []
    for t in range(count):
        own = [f"t{chr(97 + t)}{c}" for c in "abcdefgh"]
        for k in range(6):
            rows.append((len(rows), " ".join(["to", "all", "our", "readers", *own[:4], rnd.choice(NAMES), *own[4:]]) + f"\nbody {'x' * len(rows)}"))
    return rows


def test_many_templates_share_a_leaf_and_a_field(spark):
    assert len(check(spark, many_templates(12))) == 60
    assert len(check(spark, many_templates(4, 2))) == 20


def test_lines_in_two_to_six_texts_and_edited_variants(spark):
    rnd, rows = random.Random(7), []
    for t in range(12):
        n, texts = rnd.choice([7, 12, 30, 49, 50, 70]), 2 + t % 5
        line = [f"w{chr(97 + t)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
        for k in range(texts):
            changed = list(line)
            for p in rnd.sample(range(4, n), rnd.randint(0, n // 8)):
                changed[p] = rnd.choice(NAMES)
            rows.append((len(rows), " ".join(changed) + f"\nown part {'y' * len(rows)}\n" + " ".join(line[:4])))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (202, rows[0][1])]
    assert check(spark, rows)


def test_a_template_among_many_unlike_lines_of_its_leaf(spark):
    rnd, rows = random.Random(3), []
    common = [f"c{chr(97 + k)}" for k in range(9)]
    for k in range(60):
        rows.append((k, "in the end we " + " ".join(rnd.choice(common) for _ in range(10)) + f"\nz {'x' * k}"))
    for k in range(8):
        rows.append((100 + k, f"in the end we thank mister {rnd.choice(NAMES)} for his long letter to us\nz {'y' * k}"))
    got = check(spark, rows)
    assert set(range(101, 108)) <= set(got) and not set(range(60)) & set(got)
