"""Operator 1, quality classifier: a sparse rule ensemble over text statistics.

Spark computes the statistics of every whole text and stores them. A bounded, hash-chosen sample
of the labelled rows (``MAX_TRAIN`` expected rows; every labelled row below that) trains shallow
boosted trees in numpy. Every tree node is a conjunctive rule over the statistics; an L1-penalised
logistic fit keeps few of them; the kept rules are compiled into one Spark column expression,
which scores all rows. Labels, language, source and id are no statistics.

Defined edge cases: null and empty texts have all statistics 0 and a score like any other; rows
without a label are scored only; without labelled rows every score is 0.5; with labels of one
class it is that class's share, kept inside (0, 1); repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk
from churnlens.llm.graph import stored

MAX_TRAIN, CUTOFF = 20_000, 0.7
TREES, DEPTH, SHRINK, BINS, MIN_LEAF = 24, 3, 0.3, 48, 20
LASSO, STEPS = 4e-4, 300
STATISTICS = (
    "log_words", "mean_word_chars", "max_word_chars", "symbols_per_word", "bangs_per_word", "pipes_per_word", "upper_share", "digit_share",
    "punctuation_share", "repeats_share", "distinct_share", "top_word_share", "words_per_line", "dup_line_share", "sentences_per_word", "wide_share")


def _flags(signs: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


_SYMBOL, _BANG, _PIPE, _DIGIT = _flags(b"#*$%&<>"), _flags(b"!"), _flags(b"|"), _flags(b"0123456789")
_UPPER, _LETTER = _flags(bytes(range(65, 91))), _flags(bytes([*range(65, 91), *range(97, 123)]))
_PUNCT, _STOP = _flags(b".,;:?\"'()-"), _flags(b".?")


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a batch."""
    w = tk.Words(buf, offs, tk.NON_SPACE, lower=False)
    n_rows = len(offs) - 1
    n = w.counts()
    row = np.repeat(np.arange(n_rows), n)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[offs[1:]] - total[offs[:-1]]

    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))
    chars = (points[w.ends] - points[w.starts]).astype(float)
    sizes = np.bincount(row, chars, n_rows)
    longest = np.zeros(n_rows)
    np.maximum.at(longest, row, chars)
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    with np.errstate(over="ignore"):
        key = tk.mix(w.hash + row.astype(tk.U64) * tk._STEP)
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(row[first], minlength=n_rows)
    top = np.zeros(n_rows)
    np.maximum.at(top, row[first], times)
    l_start, l_end = tk.runs(buf != 10, offs)
    l_row = np.searchsorted(offs, l_start, "right") - 1
    with np.errstate(over="ignore"):
        l_key = tk.mix(tk.hash_spans(buf, l_start, l_end) + l_row.astype(tk.U64) * tk._STEP)
    lines = np.bincount(l_row, minlength=n_rows)
    l_distinct = np.bincount(l_row[np.unique(l_key, return_index=True)[1]], minlength=n_rows)
    letters = per_row(_LETTER[buf])

    def share(a, b):
        return np.divide(a, b, out=np.zeros(n_rows), where=np.asarray(b) > 0)

    return np.stack([
        np.log1p(n), share(sizes, n), longest, share(per_row(_SYMBOL[buf]), n), share(per_row(_BANG[buf]), n), share(per_row(_PIPE[buf]), n),
        share(per_row(_UPPER[buf]), letters), share(per_row(_DIGIT[buf]), sizes), share(per_row(_PUNCT[buf]), sizes),
        share(np.bincount(row, again, n_rows), n), share(distinct, n), share(top, n), share(n, lines), share(lines - l_distinct, lines),
        share(per_row(_STOP[buf]), n), share(per_row(buf >= 0xC0), sizes)], axis=1)


def text_statistics(text: Column) -> Column:
    """A struct of STATISTICS of a text column, computed by Arrow batch."""
    schema = "struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">"

    def run(col: pa.Array) -> pa.Array:
        buf, offs = tk.batch_bytes(col)
        parts, i = [], 0
        while i < len(col):  # slices of about a megabyte of text
            j = max(int(np.searchsorted(offs, offs[i] + (1 << 20), "right")) - 1, i + 1)
            parts.append(statistics(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]))
            i = j
        got = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return pa.StructArray.from_arrays([pa.array(got[:, k]) for k in range(len(STATISTICS))], names=list(STATISTICS))

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema)(text.cast("string"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, bound): above means > bound, else <= bound."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), dtype=bool)
        for f, above, bound in self.parts:
            ok &= (x[:, f] > bound) == above
        return ok

    def column(self, stats: Column) -> Column:
        ok = F.lit(True)
        for f, above, bound in self.parts:
            c = stats[STATISTICS[f]]
            ok &= (c > F.lit(bound)) if above else (c <= F.lit(bound))
        return ok


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One regression tree of second-order boosting: the rules of its nodes, and its step per row."""
    rules, step = [], np.zeros(len(grad))
    todo = [(np.arange(len(grad)), ())]
    while todo:
        rows, path = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * MIN_LEAF:
            for f in range(binned.shape[1]):
                b, size = binned[rows, f], len(cuts[f]) + 1
                n_left = np.cumsum(np.bincount(b, minlength=size))[:-1]
                gl, hl = np.cumsum(np.bincount(b, grad[rows], size))[:-1], np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                ok = (n_left >= MIN_LEAF) & (len(rows) - n_left >= MIN_LEAF)
                gain = np.where(ok, gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (f, int(gain.argmax())))
        if best[1] is None:
            step[rows] = -SHRINK * g / (h + 1)
            continue
        f, k = best[1]
        for above in (False, True):
            child = (*path, (f, above, float(cuts[f][k])))
            rules.append(Rule(tuple(sorted(child))))
            todo.append((rows[(binned[rows, f] > k) == above], child))
    return rules, step


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees, then rules, then the lasso fit (accelerated proximal gradient)."""
    if not len(y):
        return RuleModel((), (), 0.0)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return RuleModel((), (), prior)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin > k means value > cuts[k]
    margin, rules = np.full(len(y), prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, step = _tree(binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6))
        margin += step
        rules |= dict.fromkeys(found)
    rules = list(rules)
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    bound = max(0.25 * (len(rules) + 1) / 4, 1e-3)
    w, b, v, vb, t = np.zeros(r.shape[1], np.float32), prior, np.zeros(r.shape[1], np.float32), prior, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(r @ v + vb)))
        e = (p - y).astype(np.float32)
        w2 = v - (r.T @ e) / len(y) / bound
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - LASSO / bound, 0)
        b2, t2 = vb - float(e.mean()) / bound, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2.astype(np.float32), b2, t2
    kept = [k for k in range(len(rules)) if abs(w[k]) > 1e-4]
    return RuleModel(tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept), float(b))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(stats: DataFrame, labels: DataFrame) -> RuleModel:
    """``stats``: doc_id and the struct ``s``; ``labels``: doc_id and quality. Held-out ids are not read."""
    of = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max("quality").alias("quality"))
    rows = stats.join(of, "doc_id").where(~held_out(F.col("doc_id")))
    n = rows.count()
    share = min(1.0, MAX_TRAIN / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("s.*", "quality", "doc_id").toPandas()
    chosen = chosen.sort_values(["doc_id", *STATISTICS])
    return fit(chosen[list(STATISTICS)].to_numpy(), chosen["quality"].to_numpy().astype(float))


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    tk.small_batches(docs.sparkSession)
    d = tk.texts(docs, id_col, text_col)
    return stored(d.select("doc_id", text_statistics(F.col("text")).alias("s")), "statistics")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    stats = statistics_table(docs)
    model = train(stats, labels)
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("s")).alias("score")).withColumn(
        "predicted", (F.col("score") >= CUTOFF).cast("int"))
