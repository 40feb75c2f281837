"""Operator 7, quality rules: repetition coverage.

Rolling hashes of several n-gram lengths measure how many characters of a text lie inside
duplicated n-grams and duplicated lines. The base counts (words, symbols, repeated lines, repeated
three-word windows) come from the same pass. Row-wise: one scan, no shuffle.

Defined edge cases: null or empty text has no words, so every count is 0, ``base_failed`` is true
(fewer than ``MIN_WORDS`` words) and ``kept`` false. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import textkit as tk

MIN_WORDS = 50
#: most percent of the word characters that the most frequent n-gram may cover (n = 2 to 4)
TOP_LIMIT = {2: 20, 3: 18, 4: 16}
#: most percent of the word characters inside n-grams that occur twice or more (n = 5 to 10)
DUP_LIMIT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: most percent of lines, and of word characters, that lie in repeated lines
LINE_LIMIT, LINE_CHARS_LIMIT = 30, 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "dup_line_chars long, " + ", ".join(f"top_{n}gram_chars long" for n in TOP_LIMIT) + ", "
    + ", ".join(f"dup_{n}gram_chars long" for n in DUP_LIMIT)
)


def _segment(h: np.ndarray, row: np.ndarray, n: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the n-grams inside one row that can recur: an n-gram recurs only
    if both (n - 1)-grams in it do, which ``repeated`` marks by first word."""
    if len(h) < n:
        return np.zeros(0, tk.U64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    at = np.flatnonzero((row[:m] == row[n - 1:]) & repeated[:m] & repeated[1:m + 1])
    with np.errstate(over="ignore"):
        # the row goes into the key, so one sort finds the duplicates of all rows of the batch
        acc = row[at].astype(tk.U64) * tk._STEP
        for k in range(n):
            acc = acc * tk._A + h[at + k]
        return tk.mix(acc), at


def _groups(keys: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable" if stable else None)
    ks = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1]))) if len(ks) else np.zeros(0, np.int64)
    return order, first, np.diff(np.concatenate((first, [len(ks)])))


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which words lie in an n-gram that starts at one of ``at``."""
    edge = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def _sum_rows(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of each row of a batch."""
    w = tk.Words(buf, offs, tk.NON_SPACE, lower=False)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))
    chars = points[w.ends] - points[w.starts]
    n_rows = len(offs) - 1
    row = np.repeat(np.arange(n_rows), w.counts())
    out = {"n_words": w.counts(), "word_chars": _sum_rows(chars, w.bounds), "n_symbols": _sum_rows(_SYMBOL[buf], offs)}

    def covered_chars(dup_at: np.ndarray, n: int) -> np.ndarray:
        return _sum_rows(chars * _covered(dup_at, n, len(chars)), w.bounds)

    # lines: the newline-split pieces of each row, keyed by their exact bytes
    l_start, l_end = tk.runs(buf != 10, offs)
    first_word, last_word = np.searchsorted(w.starts, l_start), np.searchsorted(w.starts, l_end)
    has = last_word > first_word
    l_start, l_end, first_word, last_word = l_start[has], l_end[has], first_word[has], last_word[has]
    l_row = np.searchsorted(offs, l_start, "right") - 1
    with np.errstate(over="ignore"):
        key = tk.mix(tk.hash_spans(buf, l_start, l_end) + l_row.astype(tk.U64) * tk._STEP)
    order, first, size = _groups(key, stable=True)
    later = np.ones(len(key), dtype=bool)
    later[order[first]] = False  # the sort is stable, so the first of a group is the earliest line
    l_bounds = np.searchsorted(l_start, offs)
    word_total = np.concatenate(([0], np.cumsum(chars)))
    out |= {"n_lines": np.diff(l_bounds), "n_dup_lines": _sum_rows(later, l_bounds),
            "dup_line_chars": _sum_rows((word_total[last_word] - word_total[first_word]) * later, l_bounds)}

    repeated = np.ones(len(chars) + 1, dtype=bool)
    for n in range(2, max(DUP_LIMIT) + 1):
        keys, at = _segment(w.hash, row, n, repeated)
        order, first, size = _groups(keys)
        recur = at[order[np.repeat(size > 1, size)]]
        repeated = np.zeros(len(chars) + 1, dtype=bool)
        repeated[recur] = True
        if n == 3:
            out["n_repeat_words"] = _sum_rows(_covered(recur, 3, len(chars)), w.bounds)
        if n in TOP_LIMIT:
            # per row the most frequent n-gram (ties: one that holds most characters); one occurrence is no repeat
            many = size > 1
            lead = at[order[first[many]]]
            g_row, g_chars, g_size = row[lead], word_total[lead + n] - word_total[lead], size[many]
            rank = np.lexsort((g_chars, g_size, g_row))
            pick = np.zeros(len(size), dtype=bool)
            pick[np.flatnonzero(many)[rank[np.concatenate((g_row[rank][1:] != g_row[rank][:-1], [True]))[:len(rank)]]]] = True
            out[f"top_{n}gram_chars"] = covered_chars(at[order[np.repeat(pick, size)]], n)
        if n in DUP_LIMIT:
            out[f"dup_{n}gram_chars"] = covered_chars(recur, n)
    return out


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for part, buf, offs in tk.slices(batch, "text"):
            got = measure(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(got[c].astype(np.int64)) for c in names[1:])], names=names)


def repetition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts of ``SCHEMA``."""
    return tk.map_batches(tk.texts(docs, id_col, text_col), _map, SCHEMA)


def verdict() -> Column:
    """True when no coverage passes its limit."""
    chars = F.col("word_chars")
    ok = (100 * F.col("n_dup_lines") <= LINE_LIMIT * F.col("n_lines")) & (100 * F.col("dup_line_chars") <= LINE_CHARS_LIMIT * chars)
    for n, p in TOP_LIMIT.items():
        ok &= 100 * F.col(f"top_{n}gram_chars") <= p * chars
    for n, p in DUP_LIMIT.items():
        ok &= 100 * F.col(f"dup_{n}gram_chars") <= p * chars
    return ok


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    counts = repetition_counts(docs, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict())
