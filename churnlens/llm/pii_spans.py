"""Operator 9, personal data by weak supervision (DataFrame functions only).

Base kinds (email, ip, card, phone) follow fixed patterns and checks. The method looks at further
candidates, loose patterns for secrets and for local phone numbers, which no single rule decides:
regex, gazetteer and context labelers vote for, against or abstain. Expectation-maximisation over
the table of vote patterns estimates each labeler's reliability and the share of true spans without
any labels; its posteriors train a logistic span classifier over votes and span features, compiled
into a column expression. Candidates that it accepts and that touch no base span are added.

Spans come from the gaps and matches of a pattern: the text is split by it, and running lengths
give code-point offsets. Row-wise; the only shuffle is the count of vote patterns, whose number is
bounded by the labelers (``VOTES`` ** labelers and two features), so the driver holds a few rows.

Defined edge cases: null and empty texts have no spans; without candidates nothing is added;
repeated rows give repeated results; long digit runs and long lists match in linear time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.graph import stored

KINDS = ("email", "ip", "card", "phone")
#: base patterns; possessive loops match what greedy ones do, without backtracking
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of fewer than 16 digits can't pass, so only longer ones are matched at all
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: cheap signs without which a pattern can't match
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: candidates of the method and their labelers
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: gazetteers and context words (fixed values)
SECRET_PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|pk_live_|xox[abp]-|glpat-|AIza|eyJ)"
SECRET_CONTEXT = r"(?i)(token|secret|password|passwd|api[_ -]?key|credential|bearer)\W{0,6}$"
PHONE_CONTEXT = r"(?i)(phone|tel|telephone|mobile|fax|call|cell)\W{0,6}$"
CONTEXT_CHARS = 24
VOTES = 3
ACCEPT = 0.9


def matches(text: Column, kind: str, pattern: str, sign: str | None = None) -> Column:
    """array<struct<kind, start, stop, body>> of the leftmost non-overlapping matches."""
    possible = text.contains(sign) if sign else text.rlike("[A-Za-z0-9]")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the lengths of gap and match in turn; the sum of all before a match and its gap is its start
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,stop:int,body:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["body"])
        span = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("stop"), x["body"].alias("body"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(F.filter(pairs, lambda p: p["body"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(possible, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,stop:int,body:string>>"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d < 5, 2 * d).otherwise(2 * d - 9))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)$"))
    digits = F.regexp_replace(body, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    def valid(kind: str):
        return lambda s: _valid(kind, s["body"])

    return {k: F.filter(matches(text, k, PATTERNS[k], NEEDS[k]), valid(k)) for k in KINDS}


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, F.lit(1)).when(no if no is not None else F.lit(False), F.lit(-1)).otherwise(F.lit(0))


def _labelers(kind: str, body: Column, before: Column) -> list[Column]:
    if kind == "secret":
        hexes, letters = body.rlike("^([0-9a-f]{32,}|[0-9A-F]{32,})$"), body.rlike("^[A-Za-z_-]+$")
        mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
        return [_vote(hexes, letters), _vote(body.rlike(SECRET_PREFIXES)), _vote(before.rlike(SECRET_CONTEXT), ~before.rlike(r"[=:\"']\s?$")), _vote(mixed, ~mixed)]
    return [_vote(body.startswith("(")), _vote(body.rlike(r"[) .-]555[ .-]"), body.rlike(r"^\(?[01]")), _vote(before.rlike(PHONE_CONTEXT), before.rlike(r"[0-9#]\s?$")),
            _vote(body.rlike(r"^\(?[2-9][0-9]{2}"), body.rlike(r"^\(?[01]"))]


def candidates(text: Column) -> Column:
    """array of the method's candidates with their votes and features."""
    def facts_of(kind: str):
        def facts(s: Column) -> Column:
            before = F.substring(text, F.greatest(s["start"] + 1 - CONTEXT_CHARS, F.lit(1)), F.least(s["start"], F.lit(CONTEXT_CHARS)))
            votes = F.array(*_labelers(kind, s["body"], before))
            long = F.when(s["stop"] - s["start"] >= 32, 1).otherwise(0)
            digits = F.when(2 * F.length(F.regexp_replace(s["body"], "[^0-9]", "")) >= F.length(s["body"]), 1).otherwise(0)
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), votes.alias("votes"), long.alias("long"), digits.alias("digits"))
        return facts

    return F.concat(*[F.transform(matches(text, kind, pattern), facts_of(kind)) for kind, pattern in EXTRA.items()])


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of true spans, per labeler the chance of each vote if true and if false)."""
    n = len(patterns[0][0])
    share = 0.5
    odds = [{1: (0.6, 0.2), 0: (0.3, 0.4), -1: (0.1, 0.4)} for _ in range(n)]  # labelers are better than chance
    for _ in range(rounds):
        got = [{v: [1e-2, 1e-2] for v in (1, 0, -1)} for _ in range(n)]
        mass = [1e-2, 1e-2]
        for votes, count in patterns:
            p = posterior(share, odds, votes)
            mass[0] += p * count
            mass[1] += (1 - p) * count
            for j, v in enumerate(votes):
                got[j][v][0] += p * count
                got[j][v][1] += (1 - p) * count
        share = mass[0] / sum(mass)
        odds = [{v: (x[0] / sum(y[0] for y in g.values()), x[1] / sum(y[1] for y in g.values())) for v, x in g.items()} for g in got]
    return share, odds


def posterior(share: float, odds: list[dict[int, tuple[float, float]]], votes: Sequence[int]) -> float:
    a = math.log(share) + sum(math.log(o[v][0]) for o, v in zip(odds, votes, strict=True))
    b = math.log(1 - share) + sum(math.log(o[v][1]) for o, v in zip(odds, votes, strict=True))
    return 1 / (1 + math.exp(min(b - a, 700)))


def _logistic(rows: list[tuple[list[float], float, float]], steps: int = 400) -> list[float]:
    """Weights (intercept first) for soft targets with counts, by gradient steps with a small ridge."""
    total = sum(c for _, _, c in rows)
    w = [0.0] * (len(rows[0][0]) + 1)
    for _ in range(steps):
        g = [1e-3 * x for x in w]
        for x, target, count in rows:
            z = w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True))
            e = (1 / (1 + math.exp(-max(min(z, 50), -50))) - target) * count / total
            g[0] += e
            for j, a in enumerate(x):
                g[j + 1] += e * a
        w = [a - 1.0 * b for a, b in zip(w, g, strict=True)]
    return w


def fit_classifiers(docs: DataFrame) -> dict[str, list[float]]:
    """Weights of the span classifier of each kind, from the vote patterns of all candidates."""
    each = docs.select(F.explode(candidates(F.col("text"))).alias("c"))
    table = each.groupBy("c.kind", "c.votes", "c.long", "c.digits").agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in EXTRA:
        rows = sorted((tuple(r.votes), r.long, r.digits, r.n) for r in table if r.kind == kind)
        if not rows:
            continue
        share, odds = estimate([(v, n) for v, _, _, n in rows])
        out[kind] = _logistic([([*map(float, v), float(a), float(b)], posterior(share, odds, v), float(n)) for v, a, b, n in rows])
    return out


def _score(c: Column, weights: dict[str, list[float]]) -> Column:
    z = F.lit(-50.0)
    for kind, w in weights.items():
        s = F.lit(w[0])
        for j, a in enumerate(w[1:-2]):
            s = s + F.lit(a) * F.get(c["votes"], F.lit(j))
        z = F.when(c["kind"] == kind, s + F.lit(w[-2]) * c["long"] + F.lit(w[-1]) * c["digits"]).otherwise(z)
    return 1 / (1 + F.exp(-z))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts by base kind, base_sha256, spans) of each document."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    weights = fit_classifiers(d)
    t = F.col("text")
    rows = d.select("doc_id", *[c.alias(k) for k, c in base_spans(t).items()], candidates(t).alias("maybe"))
    base = F.transform(F.concat(*[F.col(k) for k in KINDS]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    rows = rows.withColumn("base", base)
    more = F.filter("maybe", lambda c: (_score(c, weights) >= ACCEPT) & ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    more = F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return rows.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", more)).alias("spans"))
